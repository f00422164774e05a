"""Measurement storage: typed ingest, blocks, object keys, tiers on Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalgrid import schema
from tidalgrid.operators import windows

KEY = ["node_id", "path"]
OBJECT_KEY = r"^([^/]+)/(\d+)_(\d+)_(\d+)$"
DAY_NS = 86_400_000_000_000


def ingest(rows: DataFrame, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): a row's series must exist and its value have exactly the declared type. Rejects have a ``reason``."""
    declared = series.select(*KEY, F.col("value_type").alias("_declared"))
    joined = rows.join(declared, KEY, "left")
    present = F.when(F.col("value_type") == "Real", F.col("v_double").isNotNull()).when(F.col("value_type") == "Integer", F.col("v_long").isNotNull()).when(F.col("value_type") == "Boolean", F.col("v_bool").isNotNull()).when(F.col("value_type") == "Text", F.col("v_text").isNotNull())
    reason = F.when(F.col("_declared").isNull(), "unknown path").when(~F.coalesce((F.col("_declared") == F.col("value_type")) & present, F.lit(False)), "wrong type")
    marked = joined.withColumn("reason", reason)
    return marked.where("reason is null").select(*rows.columns), marked.where("reason is not null").select(*rows.columns, "reason")


def typed(rows: DataFrame, value: str = "value") -> DataFrame:
    """``rows`` with ``value_type`` and the four value columns in place of a JSON ``value``: whole numbers that fit a long are Integer,
    other numbers Real, and a number is never taken for the other kind. Anything else has no type."""
    own = F.try_parse_json(value)
    kind = F.schema_of_variant(own)
    real = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
    name = F.when(kind == "BIGINT", "Integer").when(kind == "BOOLEAN", "Boolean").when(kind == "STRING", "Text").when(real, "Real")
    rows = rows.withColumn("value_type", name)
    for type_, column, cast in (("Real", "v_double", "double"), ("Integer", "v_long", "bigint"), ("Boolean", "v_bool", "boolean"), ("Text", "v_text", "string")):
        rows = rows.withColumn(column, F.when(F.col("value_type") == type_, F.try_variant_get(own, "$", cast)))
    return rows.drop(value)


def number_blocks(rows: DataFrame, size: str = "block_size") -> DataFrame:
    """Adds ``block``: consecutive rows in arrival order, ``size`` to a block. Places are counted by slabs of arrival order with
    carries, so a series with most of the rows is spread over tasks."""
    placed = windows.numbered(windows.dealt(rows, KEY), KEY, "_place")
    each = F.greatest(F.coalesce(F.col(size), F.lit(schema.MAX_BLOCK_SIZE)), F.lit(1))
    return placed.withColumn("_each", each).withColumn("block", F.expr("_place div _each")).select(*rows.columns, "block")


def blocks(rows: DataFrame, size: str = "block_size") -> DataFrame:
    """Blocks with the times of the first and last *arrived* row and the number of rows."""
    return number_blocks(rows, size).groupBy(*KEY, "block").agg(F.min_by("ts_ns", "seq").alias("t_start"), F.max_by("ts_ns", "seq").alias("t_end"), F.count("*").alias("n"))


def overlapping(manifest: DataFrame, t0: int, t1: int) -> DataFrame:
    """Blocks that can't be skipped for a range; bounds that can't be read never skip."""
    return manifest.where(F.coalesce((F.col("t_end") >= t0) & (F.col("t_start") <= t1), F.lit(True)))


def format_key(blocks_: DataFrame) -> DataFrame:
    """Adds ``object_key`` and the ``prefix`` of its series."""
    return blocks_.withColumn("prefix", F.format_string("%s/%010d_", "node_id", "series_id")).withColumn("object_key", F.format_string("%s/%010d_%020d_%020d", "node_id", "series_id", "t_start", "t_end"))


def parse_keys(keys: DataFrame, key: str = "object_key") -> DataFrame:
    """The manifest that object keys spell; bad keys are ignored."""
    part = lambda i: F.regexp_extract(key, OBJECT_KEY, i)
    out = keys.where(F.col(key).rlike(OBJECT_KEY)).select(F.col(key).alias("object_key"), part(1).alias("node_id"), F.expr(f"try_cast(regexp_extract({key}, '{OBJECT_KEY.replace(chr(92), chr(92) * 2)}', 2) as int)").alias("series_id"), part(3).try_cast("long").alias("t_start"), part(4).try_cast("long").alias("t_end"))
    return out.where("series_id is not null and t_start is not null and t_end is not null")


def write_measurements(rows: DataFrame, path: str, block_codec: str = "ZSTD", mode: str = "append", files: int = 1) -> None:
    """Parquet by node and day, ordered within tasks so that row groups can be skipped by path and time. Nodes with much data
    take several ``files`` a day, dealt by path."""
    day = F.floor(F.col("ts_ns") / DAY_NS).cast("int")
    rows.withColumn("day", day).repartition("node_id", "day", F.pmod(F.xxhash64("path"), F.lit(files))).sortWithinPartitions("path", "ts_ns").write.mode(mode).partitionBy("node_id", "day").option("compression", schema.BLOCK_CODECS[block_codec]).parquet(path)


def read_measurements(spark, path: str, t0: int | None = None, t1: int | None = None) -> DataFrame:
    """Rows of the closed range; days outside are pruned."""
    rows = spark.read.parquet(path)
    if t0 is not None:
        rows = rows.where((F.col("day") >= t0 // DAY_NS) & (F.col("ts_ns") >= t0))
    if t1 is not None:
        rows = rows.where((F.col("day") <= t1 // DAY_NS) & (F.col("ts_ns") <= t1))
    return rows.drop("day")


def read_latencies(spark, path: str) -> DataFrame:
    """Headerless ``sent,received,latency`` files; the protocols come from names like ``datos_http_mqtt_middleware.csv``."""
    rows = spark.read.schema("sent long, received long, latency long").csv(path).withColumn("file", F.col("_metadata.file_name"))
    return rows.withColumn("pub", F.regexp_extract("file", r"^datos_([a-z]+)_", 1)).withColumn("sub", F.regexp_extract("file", r"^datos_[a-z]+_([a-z]+)_middleware", 1))
