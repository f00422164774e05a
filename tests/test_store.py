"""Stored tiers: pruned scans, migration that is stopped and taken up, deletion with outcomes."""

from __future__ import annotations

import re

import pytest
from helpers import measure
from pyspark.sql import functions as F

from tidalgrid.operators import lifecycle
from tidalgrid.plans import views
from tidalgrid.sources import storage, store

D = storage.DAY_NS


def rows_of(df):
    return sorted((r.node_id, r.path, r.ts_ns, r.seq, r.v_double) for r in df.collect())


def two_nodes(spark, days=6):
    m = measure(spark, [(p, d * D + i * 1000, 10 * d + i) for d in range(days) for p in ("a/t", "b/t", "c/t") for i in range(20)])
    return m.unionByName(m.withColumn("node_id", F.lit("o")))


def test_scan_reads_what_the_manifest_names(spark, tmp_path, monkeypatch):
    m, path = two_nodes(spark), f"{tmp_path}/hot"
    m = m.where("node_id = 'n' or path != 'b/t' or ts_ns < 86400000000000")
    store.write(m, path, files=2)
    one = spark.createDataFrame([("o", "b/t")], "node_id string, path string")
    found = store.scan(spark, path, one, 0, 3 * D)
    assert rows_of(found) == rows_of(m.where(f"node_id = 'o' and path = 'b/t' and ts_ns <= {3 * D}"))
    assert len(found.inputFiles()) == 1
    every = store.scan(spark, path, views.keys(m), D, 2 * D)
    assert rows_of(every) == rows_of(m.where(f"ts_ns between {D} and {2 * D}"))
    assert len(every.inputFiles()) == store.manifest(spark, path).where("day in (1, 2)").select("file").distinct().count() < len(store.read(spark, path).inputFiles()) / 2
    assert re.search(r"PushedFilters: \[[^\]]*ts_ns", every._jdf.queryExecution().executedPlan().toString())
    # with more files than the driver hands over, the same rows
    monkeypatch.setattr(store, "FILES", 1)
    assert rows_of(store.scan(spark, path, views.keys(m), D, 2 * D)) == rows_of(every)
    assert store.scan(spark, path, one, 4 * D, 5 * D).count() == store.scan(spark, path, one.limit(0), 0, D).count() == 0
    assert store.manifest(spark, path).agg(F.sum("n")).first()[0] == m.count()


@pytest.mark.parametrize("stopped", ["write", "_left", "_replace", "refresh"])
def test_migration_is_taken_up(spark, tmp_path, monkeypatch, stopped):
    m = two_nodes(spark, 4)
    hot, cold, journal = (f"{tmp_path}/{x}" for x in ("hot", "cold", "journal"))
    store.write(m, hot)
    series = views.keys(m).withColumn("retention_ns", F.when(F.col("path") == "c/t", 0).otherwise(D)).withColumn("block_size", F.lit(7))
    want_hot, want_cold = (rows_of(x) for x in lifecycle.tier(m, series, 3 * D + 5))
    real, calls = getattr(store, stopped), []

    def fails(*a, **k):
        calls.append(1)
        raise OSError("stopped")

    monkeypatch.setattr(store, stopped, fails)
    with pytest.raises(OSError):
        store.migrate(spark, hot, cold, series, 3 * D + 5, journal)
    monkeypatch.setattr(store, stopped, real)
    # nothing is lost in between
    held = set(rows_of(store.read(spark, hot)))
    if store._exists(spark, f"{cold}.manifest/_batches"):
        held |= set(rows_of(store.read(spark, cold)))
    assert held == {*want_hot, *want_cold}
    store.migrate(spark, hot, cold, series, 3 * D + 5, journal)
    assert rows_of(store.read(spark, hot)) == want_hot and rows_of(store.read(spark, cold)) == want_cold
    assert not store.open_changes(spark, journal)
    for tier, want in ((hot, want_hot), (cold, want_cold)):
        assert store.manifest(spark, tier).agg(F.sum("n")).first()[0] == len(want)


def test_a_full_migration_empties_the_hot_tier(spark, tmp_path):
    m = two_nodes(spark, 2)
    hot, cold, journal = (f"{tmp_path}/{x}" for x in ("hot", "cold", "journal"))
    store.write(m, hot)
    store.migrate(spark, hot, cold, views.keys(m), 0, journal, everything=True)
    assert rows_of(store.read(spark, cold)) == rows_of(m) and store.read(spark, hot).count() == 0
    assert rows_of(store.scan(spark, cold, views.keys(m), 0, D - 1)) == rows_of(m.where(f"ts_ns < {D}"))


def test_deletion_touches_few_partitions(spark, tmp_path):
    m = two_nodes(spark, 3).where("path != 'b/t' or node_id = 'o' and ts_ns < 86400000000000")
    path = f"{tmp_path}/t"
    store.write(m, path)
    files = {r.file for r in store.manifest(spark, path).select("file").distinct().collect()}
    stones = spark.createDataFrame([("o", "b/t"), ("n", "none")], "node_id string, path string")
    assert store.delete(spark, path, stones, f"{tmp_path}/journal") == 1
    assert rows_of(store.read(spark, path)) == rows_of(lifecycle.delete_series(m, stones))
    kept = {r.file for r in store.manifest(spark, path).select("file").distinct().collect()}
    assert len(files & kept) == len(files) - 1
    rest = spark.createDataFrame([("o", "a/t"), ("o", "c/t")], "node_id string, path string")
    assert store.delete(spark, path, rest, f"{tmp_path}/journal") == 3
    assert {r.node_id for r in store.read(spark, path).collect()} == {"n"} and not (tmp_path / "t" / "node_id=o" / "day=0").exists()


def test_objects_are_deleted_and_failures_counted(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).write_text("x")
    (tmp_path / "folder" / "in").mkdir(parents=True)
    rows = [("n", 1, f"file://{tmp_path}/one"), ("n", 1, f"file://{tmp_path}/gone"), ("n", 2, f"file://{tmp_path}/folder"), ("n", 3, f"file://{tmp_path}/two"), ("n", 2, "nowhere://x/y")]
    done = store.delete_objects(spark.createDataFrame(rows, "node_id string, series_id int, file string")).persist()
    assert {(r.series_id, r.ok) for r in done.collect()} == {(1, True), (2, False), (3, True)} and not (tmp_path / "one").exists() and not (tmp_path / "two").exists()
    stones = spark.createDataFrame([("n", i, 0) for i in range(1, 5)], "node_id string, series_id int, attempts int")
    assert sorted((r.series_id, r.attempts) for r in lifecycle.settle_deletes(stones, done).collect()) == [(2, 1), (4, 0)]
