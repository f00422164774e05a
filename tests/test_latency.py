"""Latency summaries whose sketches change from one evaluation to the next, and rows without values, against DuckDB."""

from __future__ import annotations

import random

import __spark_entry__ as entry
from helpers import assert_same
from pyspark.sql import functions as F

from tidalgrid.operators import stats


def events(spark, folder, rows):
    """Events of (event_type, value)."""
    found = spark.createDataFrame([(i, 1, k, v, '{"k": 1}') for i, (k, v) in enumerate(rows)], "event_id long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds("event_id").cast("timestamp_ntz"))
    found.toPandas().astype({"ts": "datetime64[us]"}).to_parquet(f"{folder}/events.parquet", index=False)


def test_ranks_and_bins_are_told_by_the_same_cuts(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    events(spark, tmp_path, [(k, round(r.expovariate(1 / 50), 2)) for k in ("click", "view") for _ in range(3000)])

    class Functions:
        """Spark's, with a sketch that gives other cuts whenever it is evaluated, as its parts arrive in any order on a cluster."""

        def __getattr__(self, name):
            return getattr(F, name)

        def percentile_approx(self, col, *_):
            return F.udf(lambda xs: sorted(random.SystemRandom().sample(xs, 40)), "array<double>")(F.collect_set(col))

    monkeypatch.setattr(stats, "F", Functions())
    assert_same(entry.queries()["latency_summary"](spark, str(tmp_path)), entry.oracle_sql()["latency_summary"], str(tmp_path))


def test_rows_without_values_are_counted_as_in_sql(spark, tmp_path):
    events(spark, tmp_path, [("click", 1.5), ("click", None), ("click", 2.25), ("view", None), ("error", 7.0), ("error", None), (None, 3.0), (None, 4.0)])
    assert_same(entry.queries()["latency_summary"](spark, str(tmp_path)), entry.oracle_sql()["latency_summary"], str(tmp_path))
