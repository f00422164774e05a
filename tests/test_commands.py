"""Commands as a data source: committed files only, topics by name, streams that repeat a batch."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidalgrid.sources import commands

ROWS = [("n", f"r{i}", i, i % 2, ["act/a", "b c/é%", ""][i % 3], json.dumps({"x": i})) for i in range(30)]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_batches(spark, tmp_path):
    path = str(tmp_path / "out")
    made = spark.createDataFrame(ROWS, commands.SCHEMA).repartition(4)
    commands.write(made.withColumn("error", F.when(F.col("t_ns") == 4, "x")), path)
    want = sorted(r for r in ROWS if r[2] != 4)
    assert rows_of(commands.read(spark, path)) == want
    commands.write(made.where("t_ns = 4"), path)
    assert rows_of(commands.read(spark, path)) == sorted(ROWS)
    assert rows_of(commands.read(spark, path, "b c/é%")) == sorted(r for r in ROWS if r[4] == "b c/é%")
    assert commands.read(spark, path, "none").count() == commands.read(spark, str(tmp_path / "nothing")).count() == 0
    # one file for each topic and task
    assert len(list(tmp_path.glob("out/topic=*"))) == 3


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    broken = spark.createDataFrame(ROWS, commands.SCHEMA).withColumn("value", F.when(F.col("t_ns") == 21, F.raise_error(F.lit("stop"))).otherwise(F.col("value")))
    with pytest.raises(PySparkException):
        commands.write(broken.repartition(3), path)
    assert commands.read(spark, path).count() == 0
    # files that no commit names aren't read
    (tmp_path / "out" / "topic=act").mkdir(parents=True, exist_ok=True)
    (tmp_path / "out" / "topic=act" / "left.json").write_text('{"topic": "act"}\n')
    assert commands.read(spark, path).count() == 0


def test_streams(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, commands.SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run(checkpoint="state"):
        stream = spark.readStream.schema(commands.SCHEMA).parquet(f"{tmp_path}/in/*")
        commands.write_stream(stream, f"{tmp_path}/out", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
        return rows_of(commands.read(spark, f"{tmp_path}/out"))

    put("a", ROWS[:10])
    assert run() == sorted(ROWS[:10])
    put("b", ROWS[10:20])
    assert run() == sorted(ROWS[:20])
    # the first batch once more, as after a lost checkpoint: its commit stands
    assert run("other") == sorted(ROWS[:20])
