"""The series catalog: lookups, globs, tags, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalgrid import schema
from tidalgrid.functions import glob

PATH = r"^[a-zA-Z0-9_-]+(/[a-zA-Z0-9_-]+)*$"


def series_of(nodes: DataFrame) -> DataFrame:
    """One row for each series of the registry."""
    return nodes.select("node_id", F.explode(F.map_values("series")).alias("s")).select("node_id", "s.*")


def rules_of(nodes: DataFrame, node_id: str | None = None, active_only: bool = False) -> DataFrame:
    rules = nodes.select("node_id", F.explode("rules").alias("r")).select("node_id", "r.*")
    if node_id is not None:
        rules = rules.where(F.col("node_id") == node_id)
    return rules.where("active") if active_only else rules


def rule_by_id(nodes: DataFrame, rule_id: str) -> DataFrame:
    return rules_of(nodes).where(F.col("rule_id") == rule_id)


def get(series: DataFrame, path: str) -> DataFrame:
    return series.where(F.col("path") == path)


def by_glob(series: DataFrame, pattern: str = "") -> DataFrame:
    """Series whose path matches; an empty pattern means all."""
    return series.where(glob.matches(F.col("path"), pattern))


def by_tags(series: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Series that carry all the tags; no tags match everything."""
    for k, v in tags.items():
        series = series.where(F.coalesce(F.col("tags")[k] == v, F.lit(False)))
    return series


def by_device(series: DataFrame, device: str) -> DataFrame:
    return by_glob(series, f"{device}/*")


def resolve(series: DataFrame, pattern: str) -> DataFrame:
    """The (node_id, path) keys that a query pattern selects."""
    return series.where(glob.selects(F.col("path"), pattern)).select("node_id", "path").distinct()


def fleet_stats(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("n_nodes"), F.coalesce(F.sum(F.size("series")), F.lit(0)).cast("long").alias("n_series"), F.coalesce(F.sum(F.size("rules")), F.lit(0)).cast("long").alias("n_rules"))


def path_valid(path: Column) -> Column:
    return F.coalesce(path.rlike(PATH), F.lit(False))


def codec_allowed(value_type: Column, codec: Column) -> Column:
    """Whether a value codec suits a type; unknown types allow none but ``None``."""
    allowed = F.array(F.lit("None"))
    for kind, codecs in schema.VALUE_CODECS.items():
        allowed = F.when(value_type == kind, F.array(*[F.lit(c) for c in codecs])).otherwise(allowed)
    return F.coalesce(F.array_contains(allowed, codec), F.lit(False))


def validate(series: DataFrame) -> DataFrame:
    """``series`` with ``reasons``, the sorted names of what is wrong, and ``valid``."""
    checks = {
        "block_codec": ~F.coalesce(F.col("block_codec").isin(*schema.BLOCK_CODECS), F.lit(False)),
        "block_size": ~F.coalesce(F.col("block_size").between(1, schema.MAX_BLOCK_SIZE), F.lit(False)),
        "path": ~path_valid(F.col("path")),
        "value_codec": ~codec_allowed(F.col("value_type"), F.col("value_codec")),
        "value_type": ~F.coalesce(F.col("value_type").isin(*schema.VALUE_TYPES), F.lit(False)),
    }
    reasons = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())
    return series.withColumn("reasons", reasons).withColumn("valid", F.size("reasons") == 0)


def segments(series: DataFrame, path: str = "path") -> DataFrame:
    """``series`` with ``pos`` and ``segment``, a row for each segment of a path: the index by which globs meet the catalog."""
    return series.select("*", F.posexplode(F.split(path, "/")).alias("pos", "segment"))
