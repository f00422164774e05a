"""Queries on copies of the events with shifted keys, whose times are shared by copies and come late, against DuckDB."""

from __future__ import annotations

import os

import __spark_entry__ as entry
import pytest
from helpers import assert_same
from pyspark.sql import functions as F

from tidalgrid.operators import windows


@pytest.fixture(scope="module")
def copies(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("copies")
    for name in os.listdir(sf):
        if name != "events.parquet":
            os.symlink(f"{sf}/{name}", f"{folder}/{name}")
    ev = spark.read.parquet(f"{sf}/events.parquet")
    users, events = ev.agg(F.max("user_id"), F.max("event_id")).first()
    more = ev.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumns({"event_id": F.col("event_id") + F.col("c") * (events + 1), "user_id": F.col("user_id") + F.col("c") * (users + 1)})
    # a file, as the queries' stream reads one
    more.drop("c").toPandas().astype({"ts": "datetime64[us]"}).to_parquet(f"{folder}/events.parquet", index=False)
    return str(folder)


def test_replay_counts_each_time_of_a_node_once(spark, copies):
    assert_same(entry.queries()["rule_replay"](spark, copies), entry.oracle_sql()["rule_replay"], copies)


def test_percentiles_between_two_values_round_as_in_sql(spark, tmp_path):
    values = [1.0] * 6 + [15.44, 15.74]
    rows = spark.createDataFrame([(i, 1, "click", v, '{"k": 1}') for i, v in enumerate(values)], "event_id long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds("event_id").cast("timestamp_ntz"))
    rows.toPandas().astype({"ts": "datetime64[us]"}).to_parquet(f"{tmp_path}/events.parquet", index=False)
    assert_same(entry.queries()["latency_summary"](spark, str(tmp_path)), entry.oracle_sql()["latency_summary"], str(tmp_path))


@pytest.mark.parametrize("name", ["rle_runs", "dod_encode", "dict_blocks", "blocks", "codec_advice", "block_codec_advice", "rule_replay"])
def test_large_keys_are_cut_into_slabs(spark, sf, monkeypatch, name):
    monkeypatch.setattr(windows, "HOT", 10)
    monkeypatch.setattr(windows, "EACH", 300)
    assert_same(entry.queries()[name](spark, sf), entry.oracle_sql()[name], sf)
