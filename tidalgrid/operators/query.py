"""Range and last-point queries over one or two tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalgrid import schema
from tidalgrid.functions import glob
from tidalgrid.operators import catalog

KEY = ["node_id", "path"]


def _value():
    return F.struct("seq", *schema.VALUES)


def select_series(meas: DataFrame, series: DataFrame, pattern: str) -> DataFrame:
    """Measurements of the series that the pattern selects: the path test reaches the scan, the catalog join follows."""
    return meas.where(glob.selects(F.col("path"), pattern)).join(catalog.resolve(series, pattern), KEY, "left_semi")


def between(meas: DataFrame, t0: int | None, t1: int | None) -> DataFrame:
    """Rows of the closed range; a missing bound is open."""
    if t0 is not None:
        meas = meas.where(F.col("ts_ns") >= t0)
    return meas if t1 is None else meas.where(F.col("ts_ns") <= t1)


def range_query(meas: DataFrame, series: DataFrame, pattern: str, t0: int, t1: int) -> DataFrame:
    return select_series(between(meas, t0, t1), series, pattern)


def _has_value():
    return F.col("v_double").isNotNull() | F.col("v_long").isNotNull() | F.col("v_bool").isNotNull() | F.col("v_text").isNotNull()


def collapse_numbers(*tiers: DataFrame) -> DataFrame:
    """``node_id, path, ts_ns, num``: like ``collapse``, of equal times a later tier's value wins, but with the numbers only, which
    is all that aggregates see: null where the value that counts is none. Its buffers have fixed sizes."""
    rows = None
    for i, tier in enumerate(tiers):
        own = tier.where(_has_value()).select(*KEY, "ts_ns", schema.v_num().alias("num"), *[F.when(F.lit(i == k), F.col("seq")).alias(f"s{k}") for k in range(len(tiers))])
        rows = own if rows is None else rows.unionByName(own)
    best = rows.groupBy(*KEY, "ts_ns").agg(*[F.max_by("num", f"s{k}").alias(f"n{k}") for k in range(len(tiers))], *[F.max(f"s{k}").alias(f"s{k}") for k in range(len(tiers))])
    num = F.col("n0")
    for k in range(1, len(tiers)):
        num = F.when(F.col(f"s{k}").isNotNull(), F.col(f"n{k}")).otherwise(num)
    return best.select(*KEY, "ts_ns", num.alias("num"))


def collapse(meas: DataFrame, *priority: str) -> DataFrame:
    """One value for each series and time: the last arrived, or the last by ``priority`` and arrival. Null values lose."""
    order = F.struct(*priority, "seq") if priority else F.col("seq")
    has = _has_value()
    rank = F.struct(has.alias("has"), order.alias("order"))
    best = meas.groupBy(*KEY, "ts_ns").agg(F.max_by(_value(), rank).alias("v"))
    return best.select(*KEY, "ts_ns", "v.*")


def merge_tiers(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Hot values override cold ones of the same series and time, unless they are null."""
    return collapse(hot.withColumn("prio", F.lit(1)).unionByName(cold.withColumn("prio", F.lit(0))), "prio")


def combine(*results: DataFrame) -> DataFrame:
    """Union of results; of equal series and times the later non-null value wins."""
    out = results[0].withColumn("prio", F.lit(0))
    for i, r in enumerate(results[1:], 1):
        out = out.unionByName(r.withColumn("prio", F.lit(i)))
    return collapse(out, "prio")


def global_range(hot: DataFrame, cold: DataFrame, series: DataFrame, pattern: str, t0: int, t1: int) -> DataFrame:
    return merge_tiers(range_query(hot, series, pattern, t0, t1), range_query(cold, series, pattern, t0, t1))


def unavailable_nodes(series: DataFrame, status: DataFrame, pattern: str) -> DataFrame:
    """One row: the sorted nodes of the selected series that can't be reached."""
    down = catalog.resolve(series, pattern).join(status.where(~F.col("reachable")), "node_id").select("node_id").distinct()
    return down.agg(F.sort_array(F.collect_set("node_id")).alias("nodes"))


def last_point(meas: DataFrame, series: DataFrame, pattern: str, t0: int | None = None, t1: int | None = None) -> DataFrame:
    """The newest row of each selected series; of equal times the first arrived."""
    rows = select_series(between(meas, t0, t1), series, pattern)
    best = rows.groupBy(*KEY).agg(F.max_by(F.struct("ts_ns", "seq", *schema.VALUES), F.struct(F.col("ts_ns"), -F.col("seq"))).alias("v"))
    return best.select(*KEY, "v.*")


def last_point_global(hot: DataFrame, cold: DataFrame, series: DataFrame, pattern: str, t0: int | None = None, t1: int | None = None) -> DataFrame:
    """The hot answer where there is one, else the cold one."""
    a, b = last_point(hot, series, pattern, t0, t1), last_point(cold, series, pattern, t0, t1)
    fields = ["ts_ns", "seq", *schema.VALUES]
    both = a.select(*KEY, F.struct(*fields).alias("h")).join(b.select(*KEY, F.struct(*fields).alias("c")), KEY, "full_outer")
    return both.select(*KEY, F.coalesce("h", "c").alias("v")).select(*KEY, "v.*")
