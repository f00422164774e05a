"""Streams of measurements: live buckets, last values, blocks, rules.

Streams read Parquet or other files of the measurement schema; ``ts`` is a timestamp derived from ``ts_ns``. Delivery is at
least once, and ``query.collapse`` makes repeated rows harmless. There is no watermark unless a delay is given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidalgrid import schema
from tidalgrid.operators import aggregate, rules as rules_
from tidalgrid.sources import storage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read(spark, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream over measurement files."""
    rows = spark.readStream.schema(schema.MEASUREMENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return with_time(rows)


def with_time(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_micros(F.expr("ts_ns div 1000L")))


def buckets(rows: DataFrame, interval: str, aggs: list[str], start: str = "0 seconds", delay: str | None = None) -> DataFrame:
    """Tumbling windows of each series, updated as rows arrive; with ``delay`` late rows are dropped and state is freed."""
    if delay:
        rows = rows.withWatermark("ts", delay)
    made = rows.groupBy("node_id", "path", F.window("ts", interval, interval, start)).agg(*aggregate.exprs(aggs))
    return made.select("node_id", "path", F.unix_micros(F.col("window.start")).alias("start_us"), *aggs)


def last_values(rows: DataFrame) -> DataFrame:
    """The newest numeric row of each series, of equal times the first arrived; updated as rows arrive."""
    own = rows.select("node_id", "path", "ts_ns", "seq", schema.v_num().alias("num")).where("num is not null")
    best = F.max(F.struct("ts_ns", (-F.col("seq")).alias("r"), "num"))
    return own.groupBy("node_id", "path").agg(best.alias("b")).select("node_id", "path", "b.ts_ns", (-F.col("b.r")).alias("seq"), "b.num")


#: Groups of series whose open blocks are one state; Python is called once for each group of a batch.
GROUPS = 4096


class _Blocks(StatefulProcessor):
    """Numbers the rows of a group's series and gives the blocks that are full. State is the open block of each series; of a batch, a group's
    rows are held together."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle) -> None:
        self.state = handle.getValueState("open", "path array<string>, block array<long>, n array<long>, t_start array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        size, parts = self.size, list(rows)
        held = self.state.get() if self.state.exists() else ([], [], [], [])
        paths = np.concatenate([np.array(list(held[0]), object), *[p["path"].to_numpy(object) for p in parts]])
        codes, names = pd.factorize(paths, use_na_sentinel=False)
        names = np.where(pd.isna(names), None, names)
        old, codes = codes[: len(held[0])], codes[len(held[0]) :]
        open_ = np.zeros((3, len(names)), np.int64)
        open_[:, old] = np.array([list(x) for x in held[1:]], np.int64).reshape(3, -1)
        block, n, first = open_
        # a batch's rows of a group come in parts that aren't in order
        seq, times = (np.concatenate([np.zeros(0, np.int64), *[p[c].to_numpy(np.int64) for p in parts]]) for c in ("seq", "ts_ns"))
        order = np.lexsort((seq, codes))
        codes, times = codes[order], times[order]
        starts, ends = np.searchsorted(codes, np.arange(len(names))), np.searchsorted(codes, np.arange(len(names)), "right")
        place = n[codes] + np.arange(len(codes)) - starts[codes]
        full = np.flatnonzero(place % size == size - 1)
        own = codes[full]
        # a block that was open has its first time in the state
        begun = full - size + 1 < starts[own]
        done = pd.DataFrame({"path": names[own], "block": block[own] + place[full] // size, "t_start": np.where(begun, first[own], times[np.maximum(full - size + 1, 0)]), "t_end": times[full], "n": size})
        total = n + ends - starts
        fresh = (total % size > 0) & (total % size <= ends - starts)
        first[fresh] = times[(ends - total % size)[fresh]]
        self.state.update((names.tolist(), (block + total // size).tolist(), (total % size).tolist(), first.tolist()))
        done.insert(0, "node_id", key[0])
        yield done

    def close(self) -> None:
        pass


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Full blocks of ``size`` rows in arrival order."""
    own = rows.select("node_id", F.pmod(F.xxhash64("node_id", "path"), F.lit(GROUPS)).cast("int").alias("group"), "path", "ts_ns", "seq")
    return own.groupBy("node_id", "group").transformWithStateInPandas(_Blocks(size), "node_id string, path string, block long, t_start long, t_end long, n long", "Append", "None")


def ingest(rows: DataFrame, series: Callable[[], DataFrame], valid_path: str, rejects_path: str, checkpoint: str):
    """Takes in a stream of measurements whose ``value`` is JSON, or that are typed already: valid rows and rejects go to a folder
    each, under the batch's number, so a repeated batch replaces itself. ``series`` gives the catalog as it is at each batch."""

    def run(batch: DataFrame, number: int) -> None:
        own = (storage.typed(batch) if "value" in batch.columns else batch).persist()
        try:
            valid, rejects = storage.ingest(own, series())
            for part, path in ((valid, valid_path), (rejects, rejects_path)):
                part.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            own.unpersist()

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def rule_stream(rows: DataFrame, series: DataFrame, rules: DataFrame, history_path: str, handlers: rules_.Handlers, checkpoint: str, sink: Callable[[DataFrame], None] | None = None):
    """Evaluates the rules at each inserted row of a batch over what had arrived by then, and hands the commands on.

    Batches are appended to ``history_path`` under their number, so a repeated batch replaces itself; history older than
    the longest window isn't read. Commands can be told apart by rule and time.
    """
    spark = rows.sparkSession
    longest = rules.select(F.explode("conditions").alias("c")).agg(F.max("c.window_ns")).first()[0] or 0

    def run(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        own = batch.select(*schema.MEASUREMENTS.fieldNames())
        own.write.mode("overwrite").parquet(f"{history_path}/batch={number}")
        low = own.agg(F.min("ts_ns")).first()[0] - longest
        past = spark.read.parquet(history_path).where((F.col("batch") <= number) & (F.col("ts_ns") >= low)).drop("batch")
        fired = rules_.replay(past, series, rules, own)
        commands = rules_.build_commands(rules_.context(fired, past, series, rules), rules)
        handlers.run(commands)
        if sink:
            sink(commands)

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
