"""Benchmark decontamination by winnowing: fingerprints of training and test texts are joined, and hits extended.

Of each window of ten words the smallest five-word hash is kept, for documents as for benchmark items, so texts that share a
window are certain to share a fingerprint there. Both sides are rows of (fingerprint, place); the benchmark's are broadcast
while they are few (``SMALL``), else both are shuffled. A document's windows around a shared fingerprint are then joined with
the benchmark's windows by all their words, so results are exact. Items of fewer than ten words are one window, and documents
are winnowed for each such length that occurs.

Null or empty texts have no words and are clean. Rows are judged by their text alone, so repeated ones, and rows without an id,
get their own result each. Benchmark rows without words, or without an item id, match nothing. The results are columns
``n_words``, ``spans`` and ``items``; columns of these names are replaced, all others stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidalgrid.llm.common import Words, materialize, plain_unions, small_batches, text_blocks, winnow, word_grams

WINDOW, GRAM = 10, 5
#: Rows of fingerprints, or of windows, that are broadcast; a row of them takes 30 to 150 bytes.
SMALL = 200_000
#: Words before lower-casing: the pattern of the contract with A-Z as letters.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RESULTS = ("n_words", "spans", "items")


def _prints(hashes: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the winnowed grams of a text for windows of ``size`` words."""
    k = min(gram, size)
    h = word_grams(hashes, k)
    at = winnow(h, size - k + 1)
    return h[at], at


def fingerprints(texts: DataFrame, sizes: list[int], gram: int, whole: bool = False) -> DataFrame:
    """(key, size, print, at): the fingerprints of ``texts`` (key, text) for each window length, or with ``whole`` for the
    text's own length only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lengths, prints, places = [], [], [], []
            key_of = batch.column(0)
            for lo, hi, buf, offsets in text_blocks(batch.column(1)):
                words = Words(buf, offsets)
                for i in range(lo, hi):
                    a, b = int(words.text_start[i - lo]), int(words.text_end[i - lo])
                    for size in sizes:
                        if b - a == size or b - a > size and not whole:
                            h, at = _prints(words.hash[a:b], size, gram)
                            keys.append(i)
                            lengths.append(size)
                            prints.append(h.view(np.int64))
                            places.append(at.astype(np.int32))
            lists = pa.list_(pa.int64()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([key_of.take(pa.array(keys, pa.int64())), pa.array(lengths, pa.int32()), pa.array(prints, lists[0]), pa.array(places, lists[1])], names=["key", "size", "prints", "places"])

    kind = texts.schema["key"].dataType.simpleString()
    lists = texts.select("key", "text").mapInArrow(run, f"key {kind}, size int, prints array<long>, places array<int>")
    return lists.select("key", "size", F.explode(F.arrays_zip("prints", "places")).alias("x")).select("key", "size", F.col("x.prints").alias("print"), F.col("x.places").alias("at"))


def windows_at(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, size, start, words): windows of ``texts`` (key, text, found: array of size and at) that hold a found place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, starts, spans = [], [], [], []
            key_of, found = batch.column(0), batch.column(2)
            for lo, hi, buf, offsets in text_blocks(batch.column(1)):
                words = Words(buf, offsets)
                for i in range(lo, hi):
                    a, b = int(words.text_start[i - lo]), int(words.text_end[i - lo])
                    near = {(f["size"], s) for f in found[i].as_py() for s in range(f["at"] - f["size"] + min(gram, f["size"]), f["at"] + 1)}
                    for size, s in sorted(near):
                        if 0 <= s <= b - a - size:
                            keys.append(i)
                            sizes.append(size)
                            starts.append(s)
                            spans.append(words.span(a + s, size))
            yield pa.RecordBatch.from_arrays([key_of.take(pa.array(keys, pa.int64())), pa.array(sizes, pa.int32()), pa.array(starts, pa.int32()), pa.array(spans, pa.binary())], names=["key", "size", "start", "words"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "text", "found").mapInArrow(run, f"key {kind}, size int, start int, words binary")


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(size, words, item): the distinct windows of the items, ids as strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, sizes, spans = [], [], []
            for lo, hi, buf, offsets in text_blocks(batch.column(1)):
                words = Words(buf, offsets)
                for i in range(lo, hi):
                    a, b = int(words.text_start[i - lo]), int(words.text_end[i - lo])
                    size = min(window, b - a)
                    for own in {words.span(s, size) for s in range(a, b - size + 1)} if size else ():
                        items.append(i)
                        sizes.append(size)
                        spans.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(items, pa.int64())), pa.array(sizes, pa.int32()), pa.array(spans, pa.binary())], names=["item", "size", "words"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null")
    return items.mapInArrow(run, "item string, size int, words binary").distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it was counted to have few rows."""
    return F.broadcast(df) if rows <= SMALL else df


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (word ranges that a benchmark window covers) and ``items`` (their ids, as strings)."""
    spark = docs.sparkSession
    small_batches(spark)
    plain_unions(spark)
    windows = materialize(benchmark_windows(benchmark, window), "windows")
    n_windows = windows.count()
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # lengths from 1 to window
    own = F.col(f"`{text}`")
    key = F.struct(F.xxhash64(own).alias("a"), F.xxhash64(F.lit(7), own).alias("b"))
    texts = docs.where(own.isNotNull()).select(key.alias("key"), own.alias("text"))
    tests = materialize(fingerprints(windows.select(F.lit(0).alias("key"), F.col("words").cast("string").alias("text")), sizes, gram, whole=True).select("size", "print").distinct(), "test-prints")
    n_prints = tests.count()
    hits = fingerprints(texts, sizes, gram).join(_small(tests, n_prints), ["size", "print"], "left_semi")
    found = materialize(hits.groupBy("key").agg(F.collect_set(F.struct("size", "at")).alias("found")), "hits")
    candidates = texts.join(found, "key").dropDuplicates(["key"])
    extended = windows_at(candidates, window, gram).join(_small(windows, n_windows), ["size", "words"]).select("key", "size", "start", "item")
    per = extended.groupBy("key").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))).alias("spans"), F.collect_set("item").alias("items"))
    per = materialize(per.select("key", merged(F.array_sort("spans")).alias("spans"), F.array_sort("items").alias("items")), "contaminated")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULTS])
    keep = [c for c in docs.columns if c not in RESULTS]
    n_words = F.coalesce(F.regexp_count(own, F.lit(_WORD)), F.lit(0)).cast("long")
    judged = docs.select(F.when(own.isNotNull(), key).alias("key"), row.alias("row"), n_words.alias("n_words")).join(per, "key", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return judged.select(*[F.col(f"row.`{c}`") for c in keep], "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def merged(spans):
    """Sorted spans with those that touch or overlap made one."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def step(out, s):
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(spans.cast(kind), F.array().cast(kind), step)


def summary(found: DataFrame) -> DataFrame:
    """The digest columns of ``contamination``'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return summary(contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window, as they came."""
    row = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = contamination(row, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("spans") == 0).select("row.*")


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """Plain comparison of all windows, for tests."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc_id, text in docs:
        words, hit, ids = split(text), set(), set()
        for item_id, item in items:
            w = split(item)
            n = min(window, len(w))
            for s in range(len(w) - n + 1 if n and item_id is not None else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == w[s : s + n]:
                        hit.update(range(p, p + n))
                        ids.add(str(item_id))
        out.append((doc_id, len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


ORACLE = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
iwin AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iwin),
dwin AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, dwin.n, item_id FROM dwin JOIN iwin ON dwin.g = iwin.g AND dwin.n = iwin.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words ON d.doc_id IS NOT DISTINCT FROM words.doc_id LEFT JOIN ids ON d.doc_id IS NOT DISTINCT FROM ids.doc_id
"""
