"""Latency summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidalgrid import session

#: Bins of about equal numbers of rows that each group is cut into.
BINS = 256


def percentiles(rows: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """``group`` and an exact, interpolated percentile for each of ``points``; null values don't count.

    A bounded sketch cuts a group's values into bins, exact counts of the bins tell which ones hold the wanted ranks, and only
    these are put in order, as distinct values with their counts. So no task sorts a group.
    """
    own = rows.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    return _percentiles(session.keep(own.groupBy("g", "v").agg(F.count("*").alias("n")), "counts"), points).withColumnRenamed("g", group)


def _percentiles(counts: DataFrame, points: dict[str, float]) -> DataFrame:
    """``percentiles`` of kept counts (g, v, n)."""
    # kept, as a sketch's cuts depend on the order in which its parts arrive, and ranks and bins must be told by the same ones
    cuts = session.keep(counts.groupBy("g").agg(F.percentile_approx("v", [i / BINS for i in range(1, BINS)], F.lit(10_000)).alias("cuts")), "cuts")
    counted = counts.join(cuts, "g").select("g", "v", "n", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("bin"))
    before = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = counted.groupBy("g", "bin").agg(F.sum("n").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).withColumn("total", F.sum("m").over(Window.partitionBy("g")))
    place = F.array(*[F.struct(F.lit(k).alias("name"), (F.lit(p) * (F.col("total") - 1)).alias("at")) for k, p in points.items()])
    asked = bins.withColumn("p", F.explode(place)).select("g", "bin", "before", "m", "p.name", "p.at").withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    asked = asked.where("rank >= before and rank < before + m").select("g", "bin", "name", "at", "rank", (F.col("rank") - F.col("before")).alias("inner"))
    upto = Window.partitionBy("g", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.join(asked.select("g", "bin").distinct(), ["g", "bin"], "left_semi").withColumn("upto", F.sum("n").over(upto))
    found = asked.join(placed, ["g", "bin"]).where("inner < upto and inner >= upto - n")
    # where a rank lies between two, the two values are weighed with one rounding (fused), so that ties in hundredths fall as in SQL
    value = lambda k, end: F.max(F.when((F.col("name") == k) & (F.col("rank") == end), F.col("v")))
    ends = [x for k in points for x in (value(k, F.floor("at")).alias(f"{k}_low"), value(k, F.ceil("at")).alias(f"{k}_high"), F.max(F.when(F.col("name") == k, F.col("at") - F.floor("at"))).alias(f"{k}_part"))]
    between = "double(java_method('java.lang.Math', 'fma', `{0}_low`, 1 - `{0}_part`, `{0}_high` * `{0}_part`))"
    return found.groupBy("g").agg(*ends).select("g", *[F.when(F.col(f"{k}_part") == 0, F.col(f"{k}_low")).otherwise(F.expr(between.format(k))).alias(k) for k in points])


def latency_summary(rows: DataFrame, by: list[str], latency: str = "latency", count_rows: bool = False) -> DataFrame:
    """Count, mean, median, 95th and 99th percentile, extremes and sample deviation in milliseconds of nanosecond latencies, in
    hundredths. Groups without latencies have nulls. ``count_rows`` counts rows without latencies, too."""
    # all figures come from how often each value occurs
    counts = session.keep(rows.groupBy(F.struct(*by).alias("g"), F.col(latency).cast("double").alias("v")).agg(F.count("*").alias("n")), "counts")
    n, some = F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.col("v").isNotNull()
    first = counts.groupBy("g").agg(F.sum("n").alias("rows"), F.coalesce(n, F.lit(0)).alias("n"), (F.sum(F.col("v") * F.col("n")) / n).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    apart = counts.where(some).join(first.select("g", "mean"), "g").groupBy("g").agg(F.sum(F.col("n") * (F.col("v") - F.col("mean")) ** 2).alias("apart"))
    plain = first.join(apart, "g", "left").withColumn("std", F.when(F.col("n") > 1, F.sqrt(F.col("apart") / (F.col("n") - 1)))).drop("apart")
    both = plain.join(_percentiles(counts.where(some), {"median": 0.5, "p95": 0.95, "p99": 0.99}), "g", "left")
    names = ["mean", "median", "p95", "p99", "min", "max", "std"]
    return both.select("g.*", F.col("rows" if count_rows else "n").alias("n"), *[(F.rint(F.col(k) / 1e6 * 100) / 100).alias(k) for k in names])
