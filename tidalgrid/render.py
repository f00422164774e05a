"""Presentation: wide tables and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide(rows: DataFrame, value: str, paths: list[str] | None = None) -> DataFrame:
    """Sorted times by sorted paths, missing values null. Without ``paths`` the distinct paths are looked up."""
    pivot = rows.groupBy("ts_ns").pivot("path", sorted(paths)) if paths is not None else rows.groupBy("ts_ns").pivot("path")
    return pivot.agg(F.first(value)).orderBy("ts_ns")


def no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def _field(name: str):
    return lambda x: x[name]


def bucket_json(result: DataFrame, aggs: list[str]) -> DataFrame:
    """One JSON row for each series: bucket starts and one array for each aggregate, NaN and missing as null."""
    entry = F.struct("bucket", "start_ns", *[no_nan(F.col(a)).alias(a) for a in aggs])
    grouped = result.groupBy("node_id", "path").agg(F.array_sort(F.collect_list(entry)).alias("b"))
    fields = [F.transform("b", _field(a)).alias(a) for a in aggs]
    return grouped.select("node_id", "path", F.to_json(F.struct(F.col("path").alias("serie"), F.transform("b", lambda x: x["start_ns"]).alias("buckets"), *fields), {"ignoreNullFields": "false"}).alias("value"))
