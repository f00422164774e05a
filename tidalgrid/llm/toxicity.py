"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling, trained in numpy.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``, those with the smallest id hashes); everything else
is scored with it, whole texts. Scores are shifted so that the threshold found best on cross-fitted scores of the sample
falls on ``THRESHOLD``; thresholds are further calibrated by language, for deciding only: a language's own best one counts by
its toxic rows, against ``PRIOR_ROWS`` for the general one.

Null and empty texts have no words and get the score of an empty text. Labels of unknown documents and null labels are passed
over, of repeated labels the largest counts; with fewer than two usable labels of either kind every score is the prior. Repeated
documents are scored one by one; columns of the input named like results are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidalgrid.llm.common import Words, byte_values, prefix_hash, small_batches, span_hash, text_blocks

#: Labelled rows that are fitted on; a bound on the driver's work.
SAMPLE = 8_000
BUCKETS, DIM, WIDTHS, FILTERS, EPOCHS, SEED = 1 << 18, 8, (1, 2, 3), 8, 6, 7
#: Beginnings of words, in bytes, that have embedding rows of their own; pseudo-counts that shrink first log odds.
STEMS, SHRINK = (4, 5, 6), 3.0
THRESHOLD = 0.3
#: Toxic rows of a language that weigh as much as the general threshold in its own.
PRIOR_ROWS = 20


def word_ids(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text a (kinds x words) array of embedding rows: of the word and of its beginnings; 0 is padding."""
    words = Words(buf, offsets)
    prefix = prefix_hash(byte_values(words.low))
    size = words.end - words.start
    hashes = [words.hash, *(np.where(size >= k, span_hash(prefix, words.start, words.start + np.minimum(size, k)) + np.uint64(k), words.hash) for k in STEMS)]
    ids = np.stack([(h % np.uint64(BUCKETS - 1)).astype(np.int32) + 1 for h in hashes])
    return [ids[:, a:b] for a, b in zip(words.text_start.tolist(), words.text_end.tolist(), strict=True)]


def padded(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all documents, each followed by padding; starts; places where no window may start)."""
    pad = max(WIDTHS)
    sizes = np.array([d.shape[1] for d in docs], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + pad)])[:-1]
    ids = np.zeros((len(STEMS) + 1, int((sizes + pad).sum()) + pad), np.int64)
    for s, d in zip(starts.tolist(), docs, strict=True):
        ids[:, s : s + d.shape[1]] = d
    closed = np.concatenate([starts + sizes + k for k in range(1, pad)])
    return ids, starts, closed


class TextCNN:
    """Word embedding = sum of the rows of the word and of its beginnings; filters of ``WIDTHS`` words; the maxima feed one logit."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.emb[0] = 0
        self.conv = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.shift = np.float32(0)

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        x = self.emb[ids[0]]
        for row in ids[1:]:
            x += self.emb[row]
        return x

    def answers(self, x: np.ndarray, closed: np.ndarray, w: int) -> np.ndarray:
        n = len(x) - max(WIDTHS)
        c = x[:n] @ self.conv[w][0]
        for o in range(1, w):
            c += x[o : o + n] @ self.conv[w][o]
        c[closed] = -np.inf
        return c

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        if not docs:
            return np.zeros(0, np.float32)
        ids, starts, closed = padded(docs)
        x = self.vectors(ids)
        feats = [np.maximum(np.maximum.reduceat(self.answers(x, closed, w), starts, axis=0) + self.bias[w], 0) for w in WIDTHS]
        return np.concatenate(feats, axis=1) @ self.out + self.shift

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.03, batch: int = 64, seed: int = SEED) -> TextCNN:
        """Adagrad on the log loss. Each kind of row starts, on an axis of its own, from its shrunk log odds."""
        n = np.bincount(labels.astype(int), minlength=2)
        prior = (n[1] + 1) / (n.sum() + 2)
        for kind in range(len(STEMS) + 1):
            seen = np.zeros((2, BUCKETS))
            for d, y in zip(docs, labels, strict=True):
                seen[int(y), np.unique(d[kind])] += 1
            rate_of = (seen[1] + SHRINK * prior) / (seen.sum(axis=0) + SHRINK)
            odds = np.log(rate_of / (1 - rate_of)) - np.log(prior / (1 - prior))
            used = seen.sum(axis=0) > 0
            self.emb[used, kind] = np.clip(odds[used], -1, 6)
            self.conv[1][0, :, kind] = 0
            self.conv[1][0, kind, kind] = 1.0
            self.out[kind] = 0.5
        self.emb[0] = 0
        for w in WIDTHS:
            self.bias[w][:] = -1.0 if w == 1 else 0.0
        self.shift = np.float32(np.log(prior / (1 - prior)) - 1)
        rng = np.random.default_rng(seed)
        kept = {id(p): np.full(p.shape, 1e-1, np.float32) for p in (self.out, *self.conv.values(), *self.bias.values())}
        kept_emb, kept_shift = np.full(BUCKETS, 1e-1, np.float32), 1e-1

        def step(p: np.ndarray, g: np.ndarray) -> None:
            kept[id(p)] += g * g
            p -= rate * g / np.sqrt(kept[id(p)])

        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                ids, starts, closed = padded([docs[i] for i in part])
                x = self.vectors(ids)
                ends = np.append(starts[1:], len(x) - max(WIDTHS))
                tops, feats = {}, []
                for w in WIDTHS:
                    c = self.answers(x, closed, w)
                    tops[w] = np.stack([a + c[a:b].argmax(axis=0) for a, b in zip(starts, ends, strict=True)])
                    feats.append(np.take_along_axis(c, tops[w], axis=0) + self.bias[w])
                raw = np.concatenate(feats, axis=1)
                h = np.maximum(raw, 0)
                error = (1 / (1 + np.exp(-(h @ self.out + self.shift))) - labels[part]).astype(np.float32) / len(part)
                dh = (error[:, None] * self.out) * (raw > 0)
                step(self.out, h.T @ error + 1e-5 * self.out)
                kept_shift += float(error.sum()) ** 2
                self.shift -= np.float32(rate * error.sum() / np.sqrt(kept_shift))
                rows, values = [], []
                for k, w in enumerate(WIDTHS):
                    d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                    g = np.zeros_like(self.conv[w])
                    for o in range(w):
                        g[o] = np.einsum("dfe,df->ef", x[tops[w] + o], d)
                        spread = (d[:, :, None] * self.conv[w][o].T[None]).reshape(-1, DIM)
                        for row in ids:
                            rows.append(row[tops[w] + o].ravel())
                            values.append(spread)
                    step(self.conv[w], g)
                    step(self.bias[w], d.sum(axis=0))
                own, inverse = np.unique(np.concatenate(rows), return_inverse=True)
                total = np.zeros((len(own), DIM), np.float32)
                np.add.at(total, inverse, np.concatenate(values))
                kept_emb[own] += (total * total).mean(axis=1)
                self.emb[own] -= rate * total / np.sqrt(kept_emb[own])[:, None]
                self.emb[0] = 0
        return self


def best_threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit cut with the best F1."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(1, labels.sum()))
    i = int(f1.argmax())
    return float(logits[order[i]] + (logits[order[i + 1]] if i + 1 < len(order) else logits[order[i]])) / 2


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, text: str = "text") -> DataFrame:
    """(lang, toxic, ids) of a bounded sample of labelled documents that aren't held out."""
    small_batches(docs.sparkSession)
    chosen = (
        labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    found = docs.select("doc_id", lang.alias("lang"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    # of several texts of an id always the same one
    found = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "lang", "toxic", "text")).alias("x")).select("doc_id", "x.lang", "x.toxic", "x.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for _, _, buf, offsets in text_blocks(b.column(3)) for x in word_ids(buf, offsets)]
            ids = pa.array([x.astype("<i4").tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(pa.int32()), ids], names=["doc_id", "lang", "toxic", "ids"])

    return found.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, toxic int, ids binary")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, text: str = "text") -> tuple[TextCNN, dict[str | None, float]]:
    """A fitted model, and score thresholds by language (``None``: all others).

    The model is fitted on the whole sample. Thresholds come from scores of rows that their model hasn't seen: two further models are
    fitted on a half each and judge the other. That takes two rows of either label; with fewer, every score is the prior.
    """
    # partition by partition, so that the sample isn't held twice on the driver
    sample = sorted(labelled_sample(docs, labels, rows, text).toLocalIterator(), key=lambda r: r["doc_id"])
    model = TextCNN()
    y = np.array([1 if r["toxic"] > 0 else 0 for r in sample], np.float32)
    kinds = [np.flatnonzero(y == k) for k in (0, 1)]
    if min(len(k) for k in kinds) < 2:
        model.out[:] = 0
        model.shift = np.float32(np.log((y.sum() + 1) / (len(y) - y.sum() + 9)))
        return model, {None: THRESHOLD}
    ids = [np.frombuffer(r["ids"], "<i4").reshape(len(STEMS) + 1, -1) for r in sample]
    half, rng = np.zeros(len(ids), int), np.random.default_rng(SEED)
    for k in kinds:
        half[rng.permutation(k)] = np.arange(len(k)) % 2
    logits = np.zeros(len(ids), np.float32)
    for h in (0, 1):
        other = TextCNN().fit([d for d, x in zip(ids, half, strict=True) if x != h], y[half != h])
        mine = np.flatnonzero(half == h)
        for at in range(0, len(mine), 64):
            logits[mine[at : at + 64]] = other.logits([ids[i] for i in mine[at : at + 64]])
        del other
    model.fit(ids, y)
    to = np.log(THRESHOLD / (1 - THRESHOLD)) - best_threshold(logits, y)
    model.shift = np.float32(model.shift + to)
    scores = 1 / (1 + np.exp(-(logits + to)))
    cuts: dict[str | None, float] = {None: THRESHOLD}
    for lang in sorted({r["lang"] for r in sample if r["lang"]}):
        own = np.array([r["lang"] == lang for r in sample])
        if 0 < (k := float(y[own].sum())) < own.sum():
            cuts[lang] = THRESHOLD + (float(best_threshold(scores[own], y[own])) - THRESHOLD) * k / (k + PRIOR_ROWS)
    return model, cuts


@lru_cache(maxsize=2)
def _shared_model(key: str, shared) -> TextCNN:
    return shared.value


def score(docs: DataFrame, model: TextCNN, text: str = "text") -> DataFrame:
    """``docs`` with ``score``. The model has a fixed size, so it is broadcast."""
    small_batches(docs.sparkSession)
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    keep = [f for f in docs.schema.fields if f.name != "score"]
    schema = T.StructType([*keep, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _shared_model(key, shared)
        for batch in batches:
            logits = []
            for _, _, buf, offsets in text_blocks(batch.column(batch.schema.get_field_index(text)), 1 << 18):
                logits.append(own.logits(word_ids(buf, offsets)))
            values = 1 / (1 + np.exp(-np.concatenate([np.zeros(0), *logits]).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in keep), pa.array(np.round(values, 6))], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, _ = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language."""
    model, cuts = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    cut = F.lit(cuts[None])
    for lang, value in cuts.items():
        if lang is not None:
            cut = F.when(F.col("lang") == lang, value).otherwise(cut)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("text", lang.alias("lang"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return score(rows, model).where(F.col("score") < cut).select("row.*")
