"""Aggregates per series and per time bucket.

Aggregates see numeric values only; a series with none has null for all of them, its count included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalgrid import schema
from tidalgrid.operators import catalog, query

KEY = ["node_id", "path"]


def exprs(aggs: list[str], value: Column | None = None) -> list[Column]:
    """One column for each aggregate name; unknown names give null. ``count_rows`` counts all rows, whatever their values."""
    if not aggs:
        raise ValueError("at least one aggregate is needed")
    v = schema.v_num() if value is None else value
    made = {"avg": F.avg(v), "max": F.max(v), "min": F.min(v), "sum": F.sum(v), "count": F.when(F.count(v) > 0, F.count(v).cast("double")), "count_rows": F.count("*")}
    return [made.get(a, F.lit(None).cast("double")).alias(a) for a in aggs]


def of_rows(rows: DataFrame, aggs: list[str]) -> DataFrame:
    """All aggregates of each series in one pass."""
    return rows.groupBy(*KEY).agg(*exprs(aggs))


def _of_numbers(rows: DataFrame, aggs: list[str], *by: str) -> DataFrame:
    return rows.groupBy(*KEY, *by).agg(*exprs(aggs, F.col("num")))


def _filled(result: DataFrame, series: DataFrame, pattern: str, keep_empty: bool) -> DataFrame:
    return catalog.resolve(series, pattern).select(*KEY).distinct().join(result, KEY, "left") if keep_empty else result


def aggregate(meas: DataFrame, series: DataFrame, pattern: str, t0: int, t1: int, aggs: list[str], keep_empty: bool = False) -> DataFrame:
    """Aggregates of each selected series with rows in the range; with ``keep_empty`` of those without, too, as nulls."""
    rows = query.collapse_numbers(query.range_query(meas, series, pattern, t0, t1))
    return _filled(_of_numbers(rows, aggs), series, pattern, keep_empty)


def aggregate_global(hot: DataFrame, cold: DataFrame, series: DataFrame, pattern: str, t0: int, t1: int, aggs: list[str], keep_empty: bool = False) -> DataFrame:
    rows = query.collapse_numbers(*[query.range_query(x, series, pattern, t0, t1) for x in (cold, hot)])
    return _filled(_of_numbers(rows, aggs), series, pattern, keep_empty)


def n_buckets(t0: int, t1: int, interval: int) -> int:
    if interval <= 0:
        raise ValueError("the interval must be positive")
    return max(0, -(-(t1 - t0) // interval))


def bucket_grid(spark, t0: int, t1: int, interval: int) -> DataFrame:
    """Bucket numbers and starts, anchored at ``t0``."""
    return spark.range(n_buckets(t0, t1, interval)).select(F.col("id").alias("bucket"), (F.lit(t0) + F.col("id") * interval).alias("start_ns"))


def bucket_of(t0: int, n: int, interval: int) -> Column:
    """The bucket of a row; the range's end belongs to the last one."""
    return F.least(F.expr(f"(ts_ns - {t0}L) div {interval}L"), F.lit(n - 1).cast("long"))


def bucket_rows(rows: DataFrame, t0: int, t1: int, interval: int, aggs: list[str], dense: bool = True) -> DataFrame:
    """Aggregates of each series and bucket of collapsed numbers (``num``); ``dense`` adds the empty buckets of every series that
    has rows; the work is linear in the buckets."""
    n = n_buckets(t0, t1, interval)
    if n == 0:
        rows = rows.limit(0)
    sparse = _of_numbers(rows.withColumn("bucket", bucket_of(t0, max(n, 1), interval)), aggs, "bucket")
    if dense:
        # each bucket with rows brings the empty ones up to the next, the first one those before it, too
        along = Window.partitionBy(*KEY).orderBy("bucket")
        gaps = sparse.withColumn("_next", F.coalesce(F.lead("bucket").over(along), F.lit(max(n, 1)).cast("long"))).withColumn("_from", F.when(F.lag("bucket").over(along).isNull(), F.lit(0).cast("long")).otherwise(F.col("bucket")))
        every = gaps.withColumn("_at", F.explode(F.sequence(F.col("_from"), F.col("_next") - 1)))
        sparse = every.select(*KEY, F.col("_at").alias("bucket"), *[F.when(F.col("_at") == F.col("bucket"), F.col(a)).alias(a) for a in aggs])
    return sparse.withColumn("start_ns", F.lit(t0) + F.col("bucket") * interval)


def bucket_aggregate(meas: DataFrame, series: DataFrame, pattern: str, t0: int, t1: int, aggs: list[str], interval: int, dense: bool = True) -> DataFrame:
    return bucket_rows(query.collapse_numbers(query.range_query(meas, series, pattern, t0, t1)), t0, t1, interval, aggs, dense)


def bucket_global(hot: DataFrame, cold: DataFrame, series: DataFrame, pattern: str, t0: int, t1: int, aggs: list[str], interval: int) -> DataFrame:
    return bucket_rows(query.collapse_numbers(*[query.range_query(x, series, pattern, t0, t1) for x in (cold, hot)]), t0, t1, interval, aggs)


def long_form(result: DataFrame, aggs: list[str]) -> DataFrame:
    """A row for each aggregate: ``agg`` and ``value``."""
    ids = [c for c in result.columns if c not in aggs]
    return result.unpivot(ids, aggs, "agg", "value")


def of_aggregates(rows: DataFrame, agg: str, by: list[str] | None = None) -> DataFrame:
    """The same aggregate over the per-series results: an average of averages is unweighted, a count of counts is the
    number of series."""
    per = rows.groupBy(*(by or []), *KEY).agg(*exprs([agg]))
    return per.groupBy(*(by or [])).agg(*exprs([agg], F.col(agg)))
