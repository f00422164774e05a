"""Ranked lexical search: an Aho-Corasick automaton of all item terms scans whole documents.

Terms are runs of letters, digits and bytes above 0x7F, with A-Z lower-cased. A text is brought to bytes in which every other
byte is a blank, with a blank at both ends; the automaton holds each item term between two blanks, so it fires on whole
terms only, and each output names the term's items. The documents are scanned twice: once for the counts of the corpus, once
for term frequencies, scores and each task's best documents of each item. Nothing is kept of a document, so there is no index.

The automaton is broadcast. Items are dealt to as many automatons as keep each near ``TERMS`` terms, by a hash of their id; each
automaton takes two scans. An item's terms are never divided, so the bound is ``TERMS`` and the terms of one item.

Items that repeat an id are one item whose terms add up; items without an id or without terms find nothing. Rows that repeat a
document's id are ranked each for itself. Documents without an id count in the statistics and are not ranked; texts that are
null or have no terms count nowhere. Equal scores go by ascending id. Other columns are passed over, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidalgrid.llm.common import materialize, small_batches, text_blocks

#: Documents that are returned for each item; terms of an automaton; rows that a task holds before it drops those out of rank.
BEST, TERMS, HELD = 20, 200_000, 100_000

_LETTER = [b for b in range(256) if b >= 0x80 or chr(b).isalnum()]
_PLAIN = bytearray(b" " * 256)
for _b in _LETTER:
    _PLAIN[_b] = _b + 32 if 0x41 <= _b <= 0x5A else _b
_PLAIN = bytes(_PLAIN)
_MARK = bytes(0x78 if b in _LETTER else 0x20 for b in range(256))


def guarded(data: bytes) -> str:
    """The text's bytes, lower-cased, with blanks for all that is in no term; one character for each byte."""
    return f" {data.translate(_PLAIN).decode('latin-1')} "


def count_terms(data: bytes) -> int:
    return (b" " + data.translate(_MARK)).count(b" x")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, repeats): the terms as characters that stand for bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, t, n) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t, n in Counter(guarded((text or "").encode()).split()).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.column(0).type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["item_id", "term", "repeats"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.where("item_id is not null").select("item_id", "text").mapInArrow(run, f"item_id {kind}, term string, repeats long").groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats"))


class Scanner:
    """The automaton, and the number of times that each of its terms stands in a text."""

    def __init__(self, terms: list[str]):
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.automaton.add_word(f" {t} ", i)
        self.automaton.make_automaton()

    def counts(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(terms, frequencies), terms ascending."""
        found = Counter(map(itemgetter(1), self.automaton.iter(guarded(data))))
        terms = np.fromiter(found.keys(), np.int64, len(found))
        times = np.fromiter(found.values(), np.int64, len(found))
        order = np.argsort(terms)
        return terms[order], times[order]


def _texts(column: pa.Array) -> Iterator[tuple[int, bytes]]:
    for lo, _, buf, offsets in text_blocks(column):
        data = buf.tobytes()
        for i in range(len(offsets) - 1):
            yield lo + i, data[offsets[i] : offsets[i + 1]]


def corpus_counts(docs: DataFrame, terms) -> DataFrame:
    """(term, n): the number of documents that hold each term of the broadcast list, and under -1 the number of documents with
    terms, under -2 the number of all terms. Tasks add up what they have seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, df, documents, total = Scanner(terms.value), np.zeros(len(terms.value), np.int64), 0, 0
        for b in batches:
            for _, data in _texts(b.column(0)):
                n = count_terms(data)
                if n:
                    documents, total = documents + 1, total + n
                    df[scanner.counts(data)[0]] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*held, -1, -2], pa.int32()), pa.array([*df[held], documents, total], pa.int64())], names=["term", "n"])

    return docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


class _Best:
    """The best documents of each item among those seen."""

    def __init__(self, items: int, best: int):
        self.best, self.least = best, np.ones(items, np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, scores: np.ndarray, doc_id: int) -> None:
        items = np.flatnonzero(scores >= self.least)
        if len(items):
            self.parts.append((items, scores[items], np.full(len(items), doc_id, np.int64)))
            self.held += len(items)
            if self.held > max(HELD, 2 * self.best * len(self.least)):
                self.rank()

    def rank(self) -> tuple[np.ndarray, ...]:
        """(items, scores, ids) in rank."""
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        items, scores, ids = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -scores, items))
        items, scores, ids = items[order], scores[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
        place = np.arange(len(items)) - np.repeat(first, np.diff([*first, len(items)]))
        last = place == self.best - 1
        self.least[items[last]] = scores[last]
        keep = place < self.best
        self.parts, self.held = [(items[keep], scores[keep], ids[keep])], int(keep.sum())
        return self.parts[0]


def best_documents(docs: DataFrame, shared, documents: int, total: int, best: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of each item. ``shared`` holds the terms, their weights, and for
    each term its items and repeats (offsets, items, repeats), and the number of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, offsets, items, repeats, n_items = shared.value
        scanner, kept = Scanner(terms), _Best(n_items, best)
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, data in _texts(b.column(1)):
                n = count_terms(data)
                if not n:
                    continue
                m = 100 - 25 + 25 * n * documents // total
                at, tf = scanner.counts(data)
                worth = weights[at] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
                size = offsets[at + 1] - offsets[at]
                spots = np.repeat(offsets[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
                scores = np.zeros(n_items, np.int64)
                np.add.at(scores, items[spots], np.repeat(worth, size) * repeats[spots])
                kept.add(scores, ids[i])
        found = kept.rank()
        for at in range(0, len(found[0]), 10_000):
            part = [x[at : at + 10_000] for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[2]), pa.array(part[1])], names=["item", "doc_id", "score"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, best: int = BEST, terms: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    wanted = materialize(item_terms(items), "terms")
    shards = max(1, -(-wanted.count() // terms))
    found = []
    for shard in range(shards):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard).collect()
        if rows:
            found.append(_search(docs, rows, best, items.schema["item_id"].dataType.simpleString()))
    if not found:
        return wanted.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _search(docs: DataFrame, rows: list, best: int, kind: str) -> DataFrame:
    """``search`` for the items of one automaton, given as (item_id, term, repeats)."""
    spark = docs.sparkSession
    terms, names = sorted({r["term"] for r in rows}), sorted({r["item_id"] for r in rows})
    number, item = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(names)}
    counts = {r["term"]: r["n"] for r in corpus_counts(docs, spark.sparkContext.broadcast(terms)).collect()}
    documents, total = counts.get(-1, 0), counts.get(-2, 0)
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * counts.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
    own = sorted((number[r["term"]], item[r["item_id"]], r["repeats"]) for r in rows)
    offsets = np.searchsorted([x[0] for x in own], np.arange(len(terms) + 1))
    shared = spark.sparkContext.broadcast((terms, weights, offsets, np.array([x[1] for x in own], np.int64), np.array([x[2] for x in own], np.int64), len(names)))
    found = best_documents(docs, shared, documents, max(1, total), best)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= best)
    ids = F.broadcast(spark.createDataFrame([(i, x) for x, i in item.items()], f"item int, item_id {kind}"))
    return ranked.join(ids, "item").select("item_id", "rank", "doc_id", "score")


def op11_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], best: int = BEST) -> list[tuple]:
    """Plain scoring of all documents for all items, for tests: (item_id, rank, doc_id, score)."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    split_docs = [(i, split(t)) for i, t in docs]
    held = [Counter(w) for _, w in split_docs]
    documents, total = sum(bool(w) for w in held), sum(len(w) for _, w in split_docs)
    wanted: dict[int, Counter] = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, Counter()).update(split(t))
    out = []
    for i, terms in sorted(wanted.items()):
        scored = []
        for (doc_id, words), tf in zip(split_docs, held, strict=True):
            if doc_id is None or not words:
                continue
            m = 75 + 25 * len(words) * documents // total
            w = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * sum(t in h for h in held) + 1))) for t in terms if t in tf}
            score = sum(k * w[t] * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, k in terms.items() if t in tf)
            if score > 0:
                scored.append((-score, doc_id))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:best], 1)]
    return out


ORACLE = """
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(t, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM low),
iw AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
q AS (SELECT item_id, term, count(*) AS k FROM iw GROUP BY ALL),
total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM dw WHERE len(w) > 0),
tf AS (SELECT r, doc_id, term, n, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM dw) SEMI JOIN q USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
weighed AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
scored AS (SELECT item_id, r, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM tf JOIN weighed USING (term) JOIN q USING (term), total WHERE doc_id IS NOT NULL GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
