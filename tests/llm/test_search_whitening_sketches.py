"""The ranked search, the whitening and the sketches against plain versions, and on awkward tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from tidalgrid.llm import search, sketches, whitening

WORDS = "the of and re er in on ha th ea st wh ou ti ing ble ed for is that as with ly sh or nd an es".split()


def prose(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(WORDS) for _ in range(r.randint(1, 3))) for _ in range(n)]


TEXTS = [(i, " ".join(prose(i % 20, 10 + 9 * i))) for i in range(40)] + [
    (50, None), (51, ""), (52, "\n\t \r\x0b\x0c"), (53, "A"), (54, "a"), (55, "ÑANDÚ 日本語 the-THE_the\x00of"), (56, "the " * 5000), (57, "x" * 5000), (57, "the of"), (57, "the of"), (None, "the of and"), (58, " the of"),
]
ITEMS = [(1, "the of THE and"), (2, None), (3, ""), (4, "日本語 ñandÚ zzz"), (5, "of"), (5, "the of"), (6, " ".join(prose(3, 60))), (None, "the"), (7, "ñandÚ"), (8, " of")]


def table(spark, rows, names="doc_id long, text string"):
    return spark.createDataFrame(rows, names)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- ranked search ---


@pytest.mark.parametrize("terms", [200_000, 7])
def test_search(spark, monkeypatch, terms):
    monkeypatch.setattr(search, "HELD", 5)
    docs = table(spark, TEXTS).repartition(3).select(F.lit(1).alias("item_id"), "doc_id", F.lit("x").alias("term"), "text", F.lit(2).alias("score"))
    items = table(spark, ITEMS, "item_id long, text string").withColumn("rank", F.lit("x")).withColumn("doc_id", F.lit("y"))
    for best in (20, 3):
        assert result(search.search(docs, items, best, terms)) == sorted(search.brute_force(TEXTS, ITEMS, best), key=repr)


def test_search_of_texts_as_ids_and_ties(spark):
    items = spark.createDataFrame([("b", "same words"), ("a", "words")], "item_id string, text string")
    docs = table(spark, [(i, "same words") for i in range(50, 0, -1)] + [(99, "other")])
    got = search.search(docs, items).orderBy("item_id", "rank").collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in got] == [(x, k, k) for x in "ab" for k in range(1, 21)]
    assert len({r.score for r in got}) == 2


def test_search_of_empty_tables(spark):
    docs, items = table(spark, TEXTS), table(spark, ITEMS, "item_id long, text string")
    assert search.search(docs.limit(0), items).collect() == search.search(docs.where("text is null"), items).collect() == []
    none = search.search(docs, items.limit(0))
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.collect() == []
    assert search.search(docs, table(spark, [(None, "a"), (1, None), (2, "-")], "item_id long, text string")).collect() == []


def test_guards():
    data = "Ab-cB_abc 日x\x80".encode()
    assert search.guarded(data).split() == ["ab", "cb", "abc", "日x\x80".encode().decode("latin-1")]
    assert search.count_terms(data) == 4 and search.count_terms(b"") == 0 and search.count_terms(b"--") == 0
    terms, times = search.Scanner(["ab", "b", "abc", "zz"]).counts(b"ab ab abc b,AB")
    assert terms.tolist() == [0, 1, 2] and times.tolist() == [3, 1, 1]


# --- whitening ---


def vectors(n: int, d: int, seed: int = 1) -> list[tuple]:
    r = np.random.default_rng(seed)
    return [(i, (r.normal(size=d) * (1 + np.arange(d))).tolist()) for i in range(n)]


def same_up_to_sign(got, want):
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for c in {r[1] for r in want}:
        pairs = [(g[4], w[4]) for g, w in zip(got, want, strict=True) if w[1] == c]
        assert all((g is None) == (w is None) for g, w in pairs)
        g, w = np.array([p for p in pairs if p[0] is not None]).reshape(-1, 2).T
        assert not len(g) or min(np.abs(g - w).max(), np.abs(g + w).max()) < 1e-9
    assert np.allclose([r[5] or 0 for r in got], [r[5] or 0 for r in want])


@pytest.mark.parametrize("entries", [1 << 18, 1000])
def test_whitening(spark, monkeypatch, entries):
    monkeypatch.setattr(whitening, "ENTRIES", entries)
    rows = vectors(700, 6)
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]
    broken = [(-1, None), (-2, []), (-3, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (-4, [float("nan"), 0.0, 0.0, 0.0, 0.0, 0.0]), (-5, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (-6, [1.0, 2.0]), (-7, [float("-inf")] * 6)]
    df = spark.createDataFrame(rows + broken, "vec_id long, embedding array<double>").repartition(3).withColumn("x", F.lit("a")).withColumn("index", F.lit("b"))
    got = sorted(map(tuple, whitening.whitening(df).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3]))
    want = sorted(whitening.brute_force(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3]))
    same_up_to_sign(got, want)
    assert len({r[6] for r in got}) == 1 and got[0][6] < 1e-9


@pytest.mark.parametrize("rows", [[(1, [0.5, 1.0])], [(1, [2.0]), (2, [3.0]), (3, [3.0])], [(i, [float(i % 3), 2.0 * (i % 3), 0.0]) for i in range(9)], [(1, [-0.001, 0.0, 1e6, 1.0, 2.0]), (2, [0.0, -0.0, -1e6, 1.0, 2.0]), (3, [0.0, 1.0, 5.0, 1.0, 1.0])]])
def test_whitening_without_variance(spark, rows):
    got = sorted(map(tuple, whitening.whitening(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    same_up_to_sign(got, sorted(whitening.brute_force([(i, [float(np.float32(c)) for c in v]) for i, v in rows])))


def test_whitening_of_empty_tables(spark):
    none = whitening.whitening(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>"))
    assert none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and none.collect() == []


def test_deviation_beyond_doubles(spark):
    rows = [(i, [100.0 * i, float(i)]) for i in range(300)]
    got = {r.vec_id: r.deviation for r in whitening.whitening(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {r[0]: r[3] for r in whitening.brute_force(rows)} and max(got.values()) > 1 << 53
    with pytest.raises(ArithmeticException):
        whitening.whitening(spark.createDataFrame([(i, [1e5 * i, 0.0]) for i in range(300)], "vec_id long, embedding array<double>")).collect()


# --- sketches ---


def near(base: list[str], r: random.Random, edits: int) -> str:
    own = list(base)
    for _ in range(edits):
        own[r.randrange(len(own))] = f"w{r.randrange(10_000)}"
    return " ".join(own)


def test_sketches(spark):
    rows = [(i, t) for i, t in TEXTS if i is not None and i != 57]
    docs = table(spark, rows + [(None, "the of")]).repartition(3).withColumn("key", F.lit("k")).withColumn("node", F.lit(1)).withColumn("low", F.lit(2))
    got = sketches.classes(docs)
    assert result(got.where("doc_id is not null")) == sorted(sketches.brute_force(rows), key=repr)
    assert result(got.where("doc_id is null")) == [(None, 1, None, True)]


@pytest.mark.parametrize(("block", "refined"), [(256, 1024), (8, 20), (8, 1000)])
def test_large_groups_and_chains(spark, block, refined):
    """Near copies of one text, a template shared by half, and a chain whose ends don't link."""
    r = random.Random(block)
    base, half = prose(1, 150), prose(2, 60)
    rows = [(i, near(base, r, r.randrange(4))) for i in range(80)]
    rows += [(200 + i, " ".join(half + prose(100 + i, 60))) for i in range(60)]
    rows += [(300 + i, " ".join(prose(3, 200)[2 * i : 2 * i + 120])) for i in range(30)]
    rows += [(400 + i, rows[i % 3][1].upper()) for i in range(20)]
    got = sketches.classes(table(spark, rows).repartition(4), block=block, refined=refined)
    assert result(got) == sorted(sketches.brute_force(rows), key=repr)


def test_rounds_are_linear(spark):
    """A large group of near copies: rows and candidates for each node, block and pivot, never pairs of all."""
    r = random.Random(5)
    base = prose(1, 200)
    docs = table(spark, [(i, near(base, r, 1)) for i in range(600)])
    nodes = sketches.sketches(docs).select(F.col("doc_id").alias("node"), "sketch", "low").cache()
    lists = nodes.select(F.explode("low").alias("list"), "node")
    plan = sketches.planned(lists, nodes, None, 32).cache()
    biggest = plan.groupBy("list", "block", "guests").count().agg(F.max("count")).first()[0]
    assert biggest < 100 and plan.count() < 1.3 * lists.count()
    found = sketches.candidates(plan, 1)
    assert found.where("place = 1").count() == nodes.count()
    # nodes of one component aren't compared again
    roots = nodes.select("node", F.lit(0).cast("long").alias("root"))
    assert sketches.planned(lists, nodes, roots, 32).count() == 0 and sketches.split(lists, roots, 10).count() == lists.count()
    # a stray asks in every block, the others nowhere
    roots = nodes.select("node", F.when(F.col("node") == 7, 7).otherwise(0).cast("long").alias("root"))
    one = lists.where(F.col("list") == lists.groupBy("list").count().orderBy(F.desc("count")).first()["list"])
    met = sketches.planned(one, nodes, roots, 32)
    assert met.where("asking").count() <= one.count() / 32 + 1 and met.where("not asking").count() <= one.count()
    # guests are dealt to blocks, too
    roots = nodes.select("node", F.when(F.col("node") % 3 == 0, F.col("node")).otherwise(1).alias("root"))
    held = sketches.planned(one, nodes, roots, 32).groupBy("list", "block", "guests").agg(F.count_if("asking").alias("guest"), F.count("*").alias("n")).collect()
    assert max(r.guest for r in held) < 1.4 * 32 * sketches.GUESTS and max(r.n for r in held) < 1.4 * 32 * (sketches.WIDE + sketches.GUESTS)


def test_scattered_lists_are_split(spark):
    lists = table(spark, [(v, n) for n in range(40) for v in (1, 2 if n % 2 else 3, 4 + n // 4)], "list long, node long")
    none = table(spark, [], "node long, root long")
    found = sketches.split(lists, none, 10)
    groups = {frozenset(r.n) for r in found.groupBy("list").agg(F.collect_list("node").alias("n")).collect()}
    assert groups == {frozenset(range(1, 40, 2)), frozenset(range(0, 40, 2)), *[frozenset(range(4 * i, 4 * i + 4)) for i in range(10)]}


def test_common_passages_make_no_rows(spark, monkeypatch):
    """Documents that share nothing but a passage leave the lists after the first round, so that the second has no rows for
    each block of the others; linked ones are still found."""
    shared, r, made, planned = prose(7, 40), random.Random(7), [], sketches.planned
    monkeypatch.setattr(sketches, "planned", lambda *a: made.append(planned(*a).cache()) or made[-1])
    rows = [(i, " ".join(shared + prose(1000 + i, 100))) for i in range(240)]
    rows += [(300 + i, near(rows[i][1].split(), r, 1)) for i in range(5)]
    got = result(sketches.classes(table(spark, rows).repartition(4), block=8, refined=20))
    assert got == sorted(sketches.brute_force(rows), key=repr) and sum(not k for *_, k in got) == 5
    assert made[0].count() > len(rows) > made[1].count()


def test_paths_meet_at_the_threshold(spark):
    assert sketches.depth(85) == 5 and sketches.depth(100) == 63 and sketches.depth(10) == 1
    r, rows = random.Random(3), []
    for i in range(0, 200, 2):
        both = [r.getrandbits(32) for _ in range(170)]
        rows += [(i + k, np.unique(np.array(both + [r.getrandbits(32) for _ in range(15)], np.uint32)).tobytes()) for k in (0, 1)]
    found = sketches.paths(table(spark, rows, "node long, sketch binary").repartition(3))
    groups = found.groupBy("list").agg(F.collect_set("node").alias("n")).where(F.size("n") > 1).select("n").collect()
    assert {tuple(sorted(g.n)) for g in groups} == {(i, i + 1) for i in range(0, 200, 2)} and found.count() == 200 * sketches.TRIES


def proposed(nodes, roots, own):
    every = np.ones(len(nodes), bool)
    found = sketches.propose(np.array(nodes), np.array(roots), every, every, own, 5, 128, 85)
    return {(min(a, b), max(a, b)) for a, b, _ in found}


def test_estimate_is_exact_for_small_sets():
    own = [np.array(x, np.uint32) for x in ([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6, 7], [1, 2, 3, 4, 5, 9], [10, 11])]
    assert proposed([1, 2, 3, 4], range(4), own) == {(1, 2)}
    assert proposed([1, 2, 3], [0, 0, 0], own[:3]) == set()


def test_union_sketches_estimate():
    r = np.random.default_rng(1)
    for _ in range(20):
        a = np.unique(r.integers(0, 1 << 32, 900, np.uint64)).astype(np.uint32)
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.95], r.integers(0, 1 << 32, 40, np.uint64).astype(np.uint32)]))
        union = np.union1d(a, b)[:128]
        want = np.isin(union, a) & np.isin(union, b)
        assert bool(proposed([1, 2], [1, 2], [a[:128], b[:128]])) == bool(want.mean() >= 0.85 - 4.5 * np.sqrt(0.85 * 0.15 / 128) - 1e-9)


def test_repeated_ids(spark):
    a, b, c = (" ".join(prose(i, 50)) for i in (1, 2, 3))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (5, b + " end")]
    got = sketches.classes(table(spark, rows))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 1)} and got.count() == 7


def test_sketches_edges(spark):
    assert sketches.classes(table(spark, TEXTS).limit(0)).count() == 0
    assert result(sketches.classes(table(spark, [(1, None), (2, ""), (3, " ")]))) == [(i, 0, i, True) for i in (1, 2, 3)]
    with pytest.raises(ValueError):
        sketches.classes(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    long = " ".join(prose(9, 30_000))
    assert {r.component_id for r in sketches.classes(table(spark, [(8, long), (9, long + " more"), (10, " ".join(prose(8, 30_000)))])).collect()} == {8, 10}
    assert sketches.smallest(85) == 6
