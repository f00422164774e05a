"""Totals of firings in arrival order, against firings that are laid out and against DuckDB."""

from __future__ import annotations

import random

import __spark_entry__ as entry
import pytest
from helpers import assert_same, measure
from pyspark.sql import functions as F
from test_measurements import rule

from tidalgrid import schema
from tidalgrid.operators import arrival, rules as rules_, windows
from tidalgrid.plans import views


def points(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("hot", [None, 8])
def test_totals_are_those_of_laid_out_firings(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(windows, "HOT", hot)
    r = random.Random(7)
    rows = [(r.choice(["a/t", "b/t", "c/t"]), r.randrange(60) if r.random() < 0.6 else i, r.choice([None, *range(9)])) for i in range(70)]
    m = measure(spark, rows).repartition(3)
    made = []
    for agg, x, w in ((None, 5.0, 13), ("avg", 4.5, 30)):
        for path in ("a/t", "none/t", *(["*"] if hot else [])):
            one = rule(rule_id=f"{agg}-{w}-{path}", agg=agg, window=w, limit=x)
            made.append(one | {"conditions": [one["conditions"][0] | {"path": path}]})
    for logic in ("AND", "OR", "?"):
        two = rule(rule_id=f"two-{logic}", agg="avg", window=30, limit=3.0)
        c = two["conditions"][0]
        made.append(two | {"logic": logic, "conditions": [c | {"path": "a/t"}, c | {"path": "c/t", "agg": None, "op": "<", "window_ns": 13}, *([c | {"path": "none/t"}] if logic == "?" else [])]})
    rules, inserts = spark.createDataFrame(made, schema.RULES), m.where("seq % 3 = 1") if hot else None
    fired = rules_.replay(m, views.keys(m), rules, inserts)
    want = fired.groupBy("node_id", "rule_id").agg(F.count("*").alias("n_fired"), F.min("t_ns").alias("first_ns"), F.min("seq").alias("first_seq"), F.sum(F.col("t_ns") * 7 + F.col("seq")).alias("mix"))
    assert points(arrival.totals(m, views.keys(m), rules, inserts, mix=F.col("t_ns") * 7 + F.col("seq"))) == points(want)


def test_rectangles_do_not_grow_with_the_inserts(spark):
    """A rule that always fires has as many rectangles over 40 inserts as over 4,000; before, each firing was a row."""
    found = []
    for n in (40, 4000):
        m = measure(spark, [("a/t", 5, 9), ("a/t", 3, 9)] + [("b/t", 6 + (i * 7919) % n, 0) for i in range(n)])
        one = rule(agg="avg", window=10**6, limit=4.0)
        conditions = rules_.conditions_of(spark.createDataFrame([one | {"conditions": [one["conditions"][0] | {"path": "a/t"}]}], schema.RULES))
        numbers = conditions.groupBy("node_id", "rule_id", "logic").agg(F.count("*").alias("size")).withColumn("rule", F.lit(0).cast("long"))
        times = rules_.insert_times(m)
        areas = arrival.areas(m, views.keys(m), conditions, numbers, times)
        found.append(areas.count())
        assert arrival.counted(areas, arrival.places(times), {"n": F.lit(1)}).first().n == n + 2
    assert found[0] == found[1] <= 4


def test_totals_on_slabs_equal_sql(spark, sf, monkeypatch):
    monkeypatch.setattr(windows, "HOT", 10)
    monkeypatch.setattr(windows, "EACH", 300)
    assert_same(entry.queries()["rule_arrival"](spark, sf), entry.oracle_sql()["rule_arrival"], sf)
