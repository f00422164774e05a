"""Removal of repeated passages: distributed prefix doubling over sparse suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Ranking every suffix of
the corpus by ever longer prefixes would shuffle all bytes many times over, so at first sparse positions are ranked: an
anchor is the rightmost smallest 24-byte hash among those inside a 50-byte string. It depends on the string alone, so
equal strings have equal anchors, and the neighbouring strings that share one are a run. Rows of (position, rank) are
grouped by Spark in rounds over longer and longer spans, and positions whose rank no other text has drop out:

1. the 24 bytes at the anchor; runs whose anchor's rank occurs in one text only are done with;
2. all bytes of the run, 50 to 76: if a smaller document has the same ones, the whole run goes; if no other run has the
   anchor's rank, the run stays;
3. for the other runs (the first document's of each), every 50-byte string by itself.

The ranks of the first round are 64-bit hashes and only choose what is looked at further; those that decide are pairs of
64-bit hashes. Ranks are pre-aggregated to the smallest document before they are shuffled, and the joins have one row for each
rank on one side, so a passage that very many documents share can be split. No document's text is shuffled but to be joined
with its own runs.

Ids must be integers, else ValueError. Null and empty texts have no bytes. Rows without an id lose nothing and remove nothing.
Rows that repeat an id don't affect each other. Copies of a smaller id's text go entirely if they have 50 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidalgrid.llm.common import byte_values, discard, gram_hash, materialize, plain_unions, prefix_hash, sliding_min, small_batches, text_blocks

LENGTH, GRAM = 50, 24
#: Different runs of an anchor that are brought together.
HOT = 4096
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Runs:
    """Runs of neighbouring strings with one anchor, over a block of documents: first and last start, anchor and its rank."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
        n, w, low = max(0, len(buf) - length + 1), length - gram + 1, np.uint64(0xFFFF)
        anchor, grams = np.empty(n, np.int64), gram_hash(prefix_hash(byte_values(buf)), gram)
        for at in range(0, n, 32_000):
            part = grams[at : min(at + 32_000, n) + w - 1]
            key = (part & ~low) | (low - np.arange(len(part), dtype=np.uint64))
            anchor[at : at + 32_000] = (low - (sliding_min(key, w) & low)).astype(np.int64) + at
        inside = np.zeros(n, bool)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            inside[a : max(a, b - length + 1)] = True
        new = inside.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        self.first = np.flatnonzero(new)
        stop = inside.copy()
        stop[:-1] &= new[1:] | ~inside[1:]
        self.last = np.flatnonzero(stop)
        self.anchor = anchor[self.first]
        self.key = grams[self.anchor] if len(self.anchor) else np.zeros(0, np.uint64)
        self.text = np.searchsorted(offsets, self.first, "right") - 1


def _batch(schema: dict[str, pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema))


def anchors(texts: DataFrame) -> DataFrame:
    """(row, t1, t2, key, first): the anchor's rank and the first start of each run of ``texts`` (row, t1, t2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, firsts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [0]
            for lo, hi, buf, offsets in text_blocks(batch.column(3)):
                runs = Runs(buf, offsets)
                keys.append(runs.key)
                firsts.append(runs.first - offsets[runs.text])
                sizes += np.bincount(runs.text, minlength=hi - lo).tolist()
            ends = pa.array(np.cumsum(sizes), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (np.concatenate(keys).view(np.int64), np.concatenate(firsts).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], names=["row", "t1", "t2", "keys", "firsts"])

    found = texts.select("row", "t1", "t2", "text").mapInArrow(run, "row long, t1 long, t2 long, keys array<long>, firsts array<int>")
    return found.select("row", "t1", "t2", F.explode(F.arrays_zip("keys", "firsts")).alias("x")).select("row", "t1", "t2", F.col("x.keys").alias("key"), F.col("x.firsts").alias("first"))


def run_bytes(texts: DataFrame) -> DataFrame:
    """(doc, t1, first, at, b): the bytes of the runs of ``texts`` (doc, t1, text, firsts) that ``firsts`` names, and the anchor's
    place in them."""
    schema = {"doc": pa.int64(), "t1": pa.int64(), "first": pa.int32(), "at": pa.int32(), "b": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, t1, named = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3).to_pylist()
            for lo, hi, buf, offsets in text_blocks(batch.column(2)):
                runs = Runs(buf, offsets)
                wanted = np.concatenate([offsets[i - lo] + np.array(named[i], np.int64) for i in range(lo, hi)])
                own = np.flatnonzero(np.isin(runs.first, wanted))
                first, size = runs.first[own], runs.last[own] - runs.first[own] + LENGTH
                ends = np.cumsum(size)
                data = buf[np.repeat(first - ends + size, size) + np.arange(size.sum())]
                b = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                text = lo + runs.text[own]
                yield _batch(schema, [ids[text], t1[text], first - offsets[runs.text[own]], runs.anchor[own] - first, b])

    return texts.select("doc", "t1", "text", "firsts").mapInArrow(run, "doc long, t1 long, first int, at int, b binary")


def _rank(*values) -> list:
    """A pair of hashes, ``r1`` and ``r2``."""
    return [F.xxhash64(*values).alias("r1"), F.xxhash64(F.lit(7), *values).alias("r2")]


def _strings(open_runs: DataFrame) -> DataFrame:
    strings = open_runs.select("key", "doc", "t1", "first", "open", F.explode(F.sequence(F.lit(0), F.col("size") - LENGTH)).alias("i"))
    return strings.select("key", "doc", "t1", (F.col("first") + F.col("i")).alias("start"), *_rank(F.substring("open", F.col("i") + 1, F.lit(LENGTH))))


def _hit_strings(open_runs: DataFrame) -> DataFrame:
    """(doc, t1, start) of the strings of ``open_runs`` that a smaller document has.

    Equal strings have equal anchors, so runs are shuffled by these, and the strings are sorted by rank where they arrive. An
    anchor with more than ``HOT`` different runs would bring too much to one task; strings of such are pre-aggregated instead.
    """
    cold = _strings(open_runs.where("not hot").repartition("key"))
    lead = F.first("doc").over(Window.partitionBy("key", "r1", "r2").orderBy("doc"))
    found = cold.withColumn("lead", lead).where("doc > lead").select("doc", "t1", "start")
    hot = _strings(open_runs.where("hot"))
    firsts = hot.groupBy("r1", "r2").agg(F.min("doc").alias("lead"), F.max("doc").alias("last")).where("lead < last").select("r1", "r2", "lead")
    return found.unionByName(hot.join(firsts, ["r1", "r2"]).where("doc > lead").select("doc", "t1", "start"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, t1, spans): the byte ranges that go, overlapping and in no order, of each of ``docs`` (doc, t1, t2, text) that loses any."""
    spark = docs.sparkSession
    texts = docs.where(F.octet_length("text") >= LENGTH).withColumn("row", F.xxhash64("doc", "t1", "t2"))
    every = anchors(texts)
    # a text's copies don't make its anchors shared
    ranks = every.groupBy("key").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("t1", "t2") for f in (F.min, F.max)])
    ranks = materialize(ranks.where("min_t1 != max_t1 or min_t2 != max_t2").select("key"), "anchors")
    live = materialize(every.join(ranks.hint("shuffle_hash"), "key").groupBy("row").agg(F.collect_list("first").alias("firsts")), "live")
    runs = materialize(run_bytes(texts.select("row", "doc", "t1", "text").join(live.hint("shuffle_hash"), "row")), "runs")
    ranked = runs.select("*", F.octet_length("b").alias("size"), F.xxhash64(F.substring("b", F.col("at") + 1, F.lit(GRAM))).alias("key"), *_rank("at", "b"))
    leads = ranked.groupBy("r1", "r2").agg(F.min("key").alias("key"), F.min("doc").alias("lead"), F.max("doc").alias("last"))
    leads = materialize(leads, "leads")
    kinds = leads.groupBy("key").agg(F.count("*").alias("kinds"))
    mixed = leads.join(kinds, "key").where("kinds > 1 or lead < last").select("r1", "r2", "lead", "kinds")
    judged = ranked.drop("b").join(mixed, ["r1", "r2"]).where("doc > lead or kinds > 1")
    judged = materialize(judged.select("doc", "t1", "first", "size", "key", (F.col("kinds") > HOT).alias("hot"), (F.col("doc") == F.col("lead")).alias("open")), "judged")
    for x in (ranks, live, leads):
        discard(x)
    # only now the bytes of the runs that are left to compare
    left = judged.where("open").select("doc", "t1", "first", "size", "key", "hot").hint("shuffle_hash")
    left = materialize(runs.select("doc", "t1", "first", F.col("b").alias("open")).join(left, ["doc", "t1", "first"]), "open")
    discard(runs)
    hits = _hit_strings(left).select("doc", "t1", F.col("start").cast("long").alias("start"), F.lit(LENGTH).alias("size"))
    gone = judged.where("not open").select("doc", "t1", F.col("first").cast("long").alias("start"), "size")
    thin = docs.select("doc", "t1", "t2", F.octet_length("text").alias("size")).where(F.col("size") >= LENGTH)
    copied = thin.groupBy("t1", "t2").agg(F.min("doc").alias("lead"), F.max("doc").alias("last")).where("lead < last")
    copies = thin.join(copied, ["t1", "t2"]).where("doc > lead").select("doc", "t1", F.lit(0).cast("long").alias("start"), "size")
    spans = gone.unionByName(hits).unionByName(copies).groupBy("doc", "t1").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("size")).alias("end"))).alias("spans"))
    spans = materialize(spans, "spans")
    for x in (judged, left):
        discard(x)
    return spans


def cut(texts: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of ``texts`` (doc, text, spans): the removed ranges, merged, and the bytes that stay."""
    schema = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": SPAN, "kept": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_, named = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2)
            n_removed, spans, kept = [], [], []
            for i, text in enumerate(texts_):
                if not named[i].is_valid:
                    spans.append([])
                    n_removed.append(0)
                    kept.append(text)
                    continue
                start, end = named[i].values.flatten()
                edge = np.bincount(np.asarray(start), minlength=len(text) + 1) - np.bincount(np.asarray(end), minlength=len(text) + 1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
                n_removed.append(int(gone.sum()))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            yield _batch(schema, [batch.column(0), [len(x) for x in texts_], n_removed, spans, kept])

    return texts.select("doc", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): ``doc_id``, ``n_bytes``, ``n_removed``, ``spans`` (the removed byte ranges) and
    ``kept``, the bytes that stay."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id must be an integer")
    small_batches(docs.sparkSession)
    plain_unions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text")).select("doc", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"))
    spans = repeated_spans(rows.where("doc is not null"))
    return cut(rows.join(spans.hint("shuffle_hash"), ["doc", "t1"], "left"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``."""
    return repeated_passages(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """Plain search with a dictionary of all strings, for tests."""
    first: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in sorted(data):
        for s in range(len(b) - length + 1):
            first.setdefault(b[s : s + length], i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = True
        turns = int((np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1).sum())
        out.append((i, len(b), int(gone.sum()), turns, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out
