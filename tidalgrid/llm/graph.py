"""Connected components of a graph given as pairs, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalgrid.llm.common import discard, materialize, plain_unions, release


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for all ends of ``edges`` (u, v: longs); the root is the smallest node of the component.

    Loops and nulls are passed over; repeated edges count once. Each round is written to the shared folder, so lost
    executors cost a round at most. Minima are pre-aggregated; the joins have one row for each node on one side, so a
    node with very many edges can be split.
    """
    plain_unions(edges.sparkSession)
    release(edges.sparkSession)
    own = edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    own = materialize(own, label)
    state = None
    while True:
        both = own.union(own.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        before, own = own, materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), label)
        discard(before)
        now = tuple(own.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return own.select(F.col("u").alias("node"), F.col("v").alias("root")).union(own.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
