"""Retention tiering, deletion of series, pending deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalgrid.sources import storage

KEY = ["node_id", "path"]


def tier(meas: DataFrame, series: DataFrame, now_ns: int, by_block: bool = True) -> tuple[DataFrame, DataFrame]:
    """(hot, cold): rows whose block ended before ``now - retention`` are cold; retention 0 keeps all. A block with one
    recent row stays hot as a whole; without ``by_block`` each row counts for itself."""
    limits = series.select(*KEY, "retention_ns", "block_size")
    rows = meas.join(limits, KEY, "left")
    if by_block:
        rows = storage.number_blocks(rows)
        ends = rows.groupBy(*KEY, "block").agg(F.max_by("ts_ns", "seq").alias("block_end"))
        rows = rows.join(ends, [*KEY, "block"])
    else:
        rows = rows.withColumn("block_end", F.col("ts_ns"))
    old = F.coalesce((F.col("retention_ns") > 0) & (F.col("block_end") < F.lit(now_ns) - F.col("retention_ns")), F.lit(False))
    marked = rows.withColumn("_cold", old)
    return marked.where("not _cold").select(*meas.columns), marked.where("_cold").select(*meas.columns)


def tier_all(meas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A full migration: everything is cold."""
    return meas.limit(0), meas


def delete_series(meas: DataFrame, tombstones: DataFrame) -> DataFrame:
    """What is left after deleting the series named by ``tombstones`` (node_id, path)."""
    return meas.join(tombstones.select(*KEY).distinct(), KEY, "left_anti")


def pending_deletes(tombstones: DataFrame, manifest: DataFrame) -> DataFrame:
    """Objects of deleted series: tombstones (node_id, series_id, ...) with the manifest's keys."""
    return tombstones.join(manifest, ["node_id", "series_id"])


def settle_deletes(tombstones: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Tombstones after a try: done ones go, failed ones count one attempt more, untried ones stay.
    ``outcomes``: node_id, series_id, ok."""
    worst = outcomes.groupBy("node_id", "series_id").agg(F.min("ok").alias("ok"))
    joined = tombstones.join(worst, ["node_id", "series_id"], "left").where("ok is null or not ok")
    return joined.withColumn("attempts", F.col("attempts") + F.when(F.col("ok").isNotNull(), 1).otherwise(0)).drop("ok")
