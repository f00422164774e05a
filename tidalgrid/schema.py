"""Table schemas, value types and the codec table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE_TYPES = ("Boolean", "Integer", "Real", "Text")
#: Codecs that each value type allows, and block codecs with Parquet's names for them.
VALUE_CODECS = {
    "Boolean": ("None", "RLE"),
    "Integer": ("None", "RLE", "DeltaDelta", "Bits"),
    "Real": ("None", "DeltaDelta", "Xor", "RLE"),
    "Text": ("None", "RLE", "Dictionary"),
}
BLOCK_CODECS = {"None": "none", "LZ4": "lz4_raw", "ZSTD": "zstd", "Snappy": "snappy", "Gzip": "gzip"}
MAX_BLOCK_SIZE = 10_000
AGGREGATES = ("avg", "max", "min", "sum", "count")
OPERATORS = (">", ">=", "<", "<=", "==", "!=")
VALUES = ("value_type", "v_double", "v_long", "v_bool", "v_text")

MEASUREMENTS = T.StructType(
    [
        T.StructField("node_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("ts_ns", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("value_type", T.StringType()),
        T.StructField("v_double", T.DoubleType()),
        T.StructField("v_long", T.LongType()),
        T.StructField("v_bool", T.BooleanType()),
        T.StructField("v_text", T.StringType()),
    ]
)
CONDITION = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("window_ns", T.LongType()),
        T.StructField("agg", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("t_double", T.DoubleType()),
        T.StructField("t_long", T.LongType()),
        T.StructField("t_bool", T.BooleanType()),
        T.StructField("t_text", T.StringType()),
        T.StructField("aggregate_series", T.BooleanType()),
    ]
)
ACTION = T.StructType([T.StructField("kind", T.StringType()), T.StructField("target", T.StringType()), T.StructField("params", T.MapType(T.StringType(), T.StringType()))])
RULES = T.StructType(
    [
        T.StructField("node_id", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("active", T.BooleanType()),
        T.StructField("logic", T.StringType()),
        T.StructField("conditions", T.ArrayType(CONDITION)),
        T.StructField("actions", T.ArrayType(ACTION)),
    ]
)


def v_num() -> Column:
    """The numeric value: real or integer, else null (booleans and texts are skipped by aggregates)."""
    return F.when(F.col("value_type") == "Real", F.col("v_double")).when(F.col("value_type") == "Integer", F.col("v_long").cast("double"))
