"""Licence scans by a trained paragraph classifier.

A paragraph is a line. Hashed word pairs and words feed a logistic regression over licence families, trained in numpy on
variants of the templates below and on the corpus's other lines: it starts from a bounded sample (``SAMPLE_DOCS``), and then
tasks add up the loss and its slope over one half of all lines (``PASSES``). Judged are lines as
they are, and then overlapping runs of words of several sizes (``WINDOWS``) over the rest of the whole text, line breaks or
not, so wrapped notices and notices within long lines are seen. The probability needed for a family is calibrated so that
hardly any line of the other half passes with any of its runs (``FALSE_RATE``); below it a run is unknown. A prediction counts when
comparison with the family's templates confirms it: enough of a template's words stand in the run in order. Of runs that
overlap, the one that shares most words with its template counts.

Null and empty texts have no paragraphs. Rows are judged one by one, repeated or not; columns named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidalgrid.llm.common import Words, small_batches, splitmix, text_blocks
from tidalgrid.operators import stats

#: Short notices of public licences, by family.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Use of this source code is governed by a BSD-style license."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "public-domain": ["This work is dedicated to the public domain under CC0 1.0 Universal."],
    "reserved": ["All rights reserved.", "Copyright. All rights reserved."],
}
FAMILIES = sorted(TEMPLATES)
FEATURES = 1 << 14
#: Documents whose lines are sampled for the start of fitting, by smallest id hash; and lines taken from them, by smallest hash.
SAMPLE_DOCS, SAMPLE_LINES = 500, 6_000
#: Readings of all lines after the start; each tries a step, and only steps that lower the loss over all of them are kept.
PASSES = 4
FALSE_RATE, CONFIRM, SEED = 0.001, 0.8, 11
#: Runs of words that are judged: sizes and steps. Each stretch of up to 41 words is inside one, the longest template has 23;
#: longer lines are judged by their runs only.
WINDOWS = ((4, 1), (8, 2), (16, 4), (32, 8), (48, 8))
LONGEST = WINDOWS[-1][0]
#: Characters of the pieces in which sampled lines reach the driver (bytes of those that tasks fit on), and runs scored at once.
PIECE, GROUP = 2000, 1 << 16
#: Tasks' sums are whole numbers of this part of one, so that they don't depend on the order in which they are added up.
UNIT = 1 << 24


def paragraphs(buf: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, start byte of each non-empty line, row of each line)."""
    breaks = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.append(starts[1:], len(buf))
    full = (ends - starts > 1) | ((ends - starts == 1) & (buf[np.minimum(starts, len(buf) - 1)] != 10)) if len(buf) else np.zeros(len(starts), bool)
    starts = starts[full]
    return Words(buf, offsets), starts, np.searchsorted(offsets, starts, "right") - 1


def features(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature of each word, feature of the pair with the word before; ``FEATURES`` for the first word)."""
    one = (h % np.uint64(FEATURES)).astype(np.int64)
    with np.errstate(over="ignore"):
        pair = (splitmix(h[1:] * np.uint64(3) + h[:-1]) % np.uint64(FEATURES)).astype(np.int64)
    return one, np.concatenate([np.full(min(1, len(h)), FEATURES), pair])


class LicenseModel:
    """Softmax regression over ``FAMILIES`` and, last, other text."""

    def __init__(self):
        self.weights = np.zeros((FEATURES + 1, len(FAMILIES) + 1), np.float32)  # the last row stands for a missing pair
        self.bias = np.zeros(len(FAMILIES) + 1, np.float32)
        self.kept = np.full(self.weights.shape, 1e-3, np.float32)  # squared slopes so far
        self.cut = 0.5

    def best(self, words: Words, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(likeliest family, its probability) of each run of words, which isn't empty; probability 0 where other text is likelier."""
        family, p = np.zeros(len(begin), np.int64), np.zeros(len(begin))
        order = np.argsort(begin, kind="stable")
        by_class = self.weights.T.astype(np.float64, "C")
        for at in range(0, len(order), GROUP):
            own = order[at : at + GROUP]
            lo, hi = int(begin[own].min()), int(end[own].max())
            a, b = begin[own] - lo, end[own] - lo
            one, pair = features(words.hash[lo:hi])
            scale, z, sums = 1 / np.sqrt(2 * (b - a) - 1), np.empty((len(self.bias), len(own))), np.zeros(hi - lo + 1)
            for k, w in enumerate(by_class):
                pairs = w.take(pair)
                np.cumsum(w.take(one) + pairs, out=sums[1:])
                # a run's first word makes no pair
                z[k] = (sums.take(b) - sums.take(a) - pairs.take(a)) * scale + self.bias[k]
            top = z[:-1].max(axis=0)
            some = np.flatnonzero(top > z[-1])
            family[own[some]] = z[:-1, some].argmax(axis=0)
            p[own[some]] = 1 / np.exp(z[:, some] - top[some]).sum(axis=0)
        return family, p

    def fit(self, lines: list[str], labels: np.ndarray, epochs: int = 12, rate: float = 0.5) -> LicenseModel:
        rng = np.random.default_rng(SEED)
        own = []
        for text in lines:
            raw = np.frombuffer(text.replace("\n", " ").encode(), np.uint8)
            one, pair = features(Words(raw, np.array([0, len(raw)])).hash)
            f = np.concatenate([one, pair[1:]])
            own.append((f, 1 / np.sqrt(max(1, len(f)))))
        for _ in range(epochs):
            for i in rng.permutation(len(own)):
                f, scale = own[i]
                z = self.weights[f].sum(axis=0) * scale + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                g = np.broadcast_to(p * scale, (len(f), len(p)))
                np.add.at(self.kept, f, g * g)
                np.add.at(self.weights, f, -rate * g / np.sqrt(self.kept[f]))
                self.bias -= 0.02 * p
        return self


def variants(text: str, rng: np.random.Generator, n: int) -> list[str]:
    """A template with words dropped, added or in another case."""
    out = [text]
    for _ in range(n):
        words = [w for w in text.split() if rng.random() > 0.06]
        if rng.random() < 0.5:
            words = ["Copyright", "(c)", str(rng.integers(1990, 2026)), *words] if rng.random() < 0.5 else [*words, "See", "LICENSE", "for", "details."]
        out.append(" ".join(words).upper() if rng.random() < 0.1 else " ".join(words))
    return out


def common_words(line: list[bytes], template: list[bytes]) -> int:
    """How many of the template's words stand in the line in the same order (longest common subsequence, bit-parallel)."""
    places: dict[bytes, int] = {}
    for j, t in enumerate(template):
        places[t] = places.get(t, 0) | 1 << j
    full = row = (1 << len(template)) - 1
    for w in line:
        if m := places.get(w):
            row = ((row + (row & m)) | (row & ~m)) & full
    return len(template) - row.bit_count()


def _words_of(text: str) -> list[bytes]:
    raw = np.frombuffer(text.encode(), np.uint8)
    words = Words(raw, np.array([0, len(raw)]))
    return [words.text(i) for i in range(len(words.start))]


@lru_cache(maxsize=1)
def _template_words() -> dict[str, list[list[bytes]]]:
    return {f: [_words_of(t) for t in ts] for f, ts in TEMPLATES.items()}


def similarity(line: list[bytes], family: str) -> tuple[float, int, list[bytes]]:
    """(share of a template's words in the line, their number, the template), for the family's template with most of them
    among those that confirm, else with the greatest share."""
    each = [(n / max(1, len(t)), n, t) for t in _template_words()[family] for n in [common_words(line, t)]]
    return max(each, key=lambda x: (x[0] >= CONFIRM, x[1] if x[0] >= CONFIRM else 0, x[0]))


def windows(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the sizes ``WINDOWS`` in stretches of words; what is shorter than a size is one run."""
    starts, ends, least = [], [], 0
    for size, step in WINDOWS:
        own = end - begin > least
        a, b = begin[own], end[own]
        count = 1 + np.maximum(0, -(-(b - a - size) // step))
        first = np.cumsum(count) - count
        at = np.repeat(a, count) + step * (np.arange(count.sum()) - np.repeat(first, count))
        at = np.minimum(at, np.repeat(np.maximum(a, b - size), count))
        starts.append(at)
        ends.append(np.minimum(at + size, np.repeat(b, count)))
        least = size
    return np.concatenate(starts), np.concatenate(ends)


def line_words(words: Words, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of each line."""
    edge = np.searchsorted(words.start, np.append(starts, len(words.low)))
    return edge[:-1], edge[1:]


def _narrow(line: list[bytes], template: list[bytes], n: int) -> tuple[int, int]:
    """The shortest end, then the latest beginning, of a part of the line with as many of the template's words."""
    lo, hi = 0, len(line)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if common_words(line[:mid], template) == n else (mid + 1, hi)
    end, lo, hi = hi, 0, hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if common_words(line[mid:end], template) == n else (lo, mid - 1)
    return lo, end


def judge(model: LicenseModel, words: Words, starts: np.ndarray) -> list[tuple[int, int, float, float]]:
    """(first word, family, probability, similarity) of the runs of words that pass the cut, in order, none overlapping.

    Lines that a template confirms are taken first; windows run over what is left between them.
    """
    text = lambda a, b: [words.text(j) for j in range(a, b)]
    a, b = line_words(words, starts)
    short = (b > a) & (b - a <= LONGEST)
    a, b = a[short], b[short]
    family, p = model.best(words, a, b)
    found, rest, taken = [], [], np.zeros(len(words.start), bool)
    for i in np.flatnonzero(p >= model.cut).tolist():
        at, end, k = int(a[i]), int(b[i]), int(family[i])
        share, n, _ = similarity(text(at, end), FAMILIES[k])
        if share >= CONFIRM:
            found.append((at, k, float(p[i]), share))
            taken[at:end] = True
        else:
            rest.append((False, 0, share, float(p[i]), at, end, k))
    edge = np.zeros(len(taken) + 1, bool)
    edge[words.text_start] = edge[words.text_end] = edge[0] = edge[-1] = True
    edge[1:-1] |= taken[1:] != taken[:-1]
    edge = np.flatnonzero(edge)
    free = ~taken[edge[:-1]]
    a, b = windows(edge[:-1][free], edge[1:][free])
    family, p = model.best(words, a, b)
    for i in np.flatnonzero(p >= model.cut).tolist():
        at, end, k = int(a[i]), int(b[i]), int(family[i])
        line = text(at, end)
        share, n, template = similarity(line, FAMILIES[k])
        if share >= CONFIRM:
            x, y = _narrow(line, template, n)
            rest.append((True, n, share, float(p[i]), at + x, at + y, k))
        else:
            rest.append((False, 0, share, float(p[i]), at, end, k))
    for _, _, share, chance, at, end, k in sorted(rest, reverse=True):
        if not taken[at:end].any():
            taken[at:end] = True
            found.append((at, k, chance, share))
    return sorted(found)


def slope(model: LicenseModel, words: Words, begin: np.ndarray, end: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(slope of the weights, of the bias, loss) of the log loss, added up over runs of words, which aren't empty."""
    size = end - begin
    first = np.cumsum(size) - size
    run = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(run)) - first[run] + begin[run]
    one, pair = features(words.hash)
    one, pair = one[at], pair[at]
    pair[first] = FEATURES
    scale = 1 / np.sqrt(2 * size - 1)
    z = np.stack([np.add.reduceat(w.take(one) + w.take(pair), first) for w in model.weights.T.astype(np.float64, "C")]) * scale + model.bias[:, None]
    p = np.exp(z - z.max(axis=0))
    p /= p.sum(axis=0)
    own = labels, np.arange(len(size))
    loss = -np.log(np.maximum(p[own], 1e-300)).sum()
    p[own] -= 1
    f, each = np.concatenate([one, pair]), np.concatenate([run, run])
    g = np.stack([np.bincount(f, x.take(each), FEATURES + 1) for x in p * scale]).T
    g[FEATURES] = 0
    return g, p.sum(axis=1), float(loss)


@lru_cache(maxsize=1)
def _template_sets() -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of the templates' words, which of them each template has)."""
    sets = []
    for t in (t for ts in TEMPLATES.values() for t in ts):
        raw = np.frombuffer(t.encode(), np.uint8)
        sets.append(np.unique(Words(raw, np.array([0, len(raw)])).hash))
    every = np.unique(np.concatenate(sets))
    return every, np.stack([np.isin(every, x) for x in sets])


def pieces(words: Words, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, key) of the lines' pieces that have words and resemble no template; equal pieces have equal keys."""
    a, b = line_words(words, starts)
    line = np.repeat(np.arange(len(a)), b - a)
    part = (words.start - starts[line]) // PIECE
    first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (part[1:] != part[:-1])])) if len(line) else np.zeros(0, np.int64)
    every, sets = _template_sets()
    has = np.zeros((len(first), len(every)), bool)
    at = np.minimum(np.searchsorted(every, words.hash), len(every) - 1)
    hit = np.flatnonzero(every[at] == words.hash)
    has[np.searchsorted(first, hit, "right") - 1, at[hit]] = True
    other = ~(has.astype(np.float32) @ sets.T >= 0.7 * sets.sum(axis=1)).any(axis=1)
    with np.errstate(over="ignore"):
        key = splitmix(np.add.reduceat(words.hash, first)) if len(first) else np.zeros(0, np.uint64)
    return first[other], np.append(first[1:], len(line))[other], key[other]


def _blocks(batches: Iterator[pa.RecordBatch], start: np.ndarray, fitted: bool) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """(words, first word, end word) of the pieces that are fitted on, or of the others; pieces of the start's are fitted on."""
    for batch in batches:
        for _, _, buf, offsets in text_blocks(batch.column(0), 1 << 18):
            words, starts, _ = paragraphs(buf, offsets)
            a, b, key = pieces(words, starts)
            own = ((key & np.uint64(1) == 0) | np.isin(key, start)) == fitted
            if own.any():
                yield words, a[own], b[own]


def whole_slope(docs: DataFrame, model: LicenseModel, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(slope of the weights, of the bias, loss, pieces) over the fitted half of all lines; tasks add up their own lines, and
    Spark the tasks by feature."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    classes, other = len(model.bias), len(FAMILIES)
    names = ["feature", *(f"c{k}" for k in range(classes))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # after the features' rows: the bias's, and one of loss and number
        total, loss, seen = np.zeros((classes, FEATURES + 2)).T, 0.0, 0
        for words, a, b in _blocks(batches, start, True):
            g, bias, own = slope(shared.value, words, a, b, np.full(len(a), other))
            total[:FEATURES] += g[:FEATURES]
            total[FEATURES] += bias
            loss, seen = loss + own, seen + len(a)
        total[FEATURES + 1, :2] = loss, seen
        rows = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *(pa.array(np.rint(x * UNIT).astype(np.int64)) for x in total[rows].T)], names=names)

    each = docs.mapInArrow(run, ", ".join(["feature int", *(f"{c} long" for c in names[1:])]))
    found = each.groupBy("feature").agg(*(F.sum(c).alias(c) for c in names[1:])).toArrow()
    total = np.zeros((FEATURES + 2, classes))
    total[found.column(0).to_numpy()] = np.stack([found.column(c).to_numpy() for c in names[1:]], axis=1) / UNIT
    shared.destroy()
    loss, seen = total[FEATURES + 1, :2]
    bias = total[FEATURES].copy()
    total[FEATURES] = 0
    return total[: FEATURES + 1], bias, float(loss), float(seen)


def refine(docs: DataFrame, model: LicenseModel, texts: list[str], labels: np.ndarray, start: np.ndarray, share: int, rate: float = 0.5) -> LicenseModel:
    """Steps down the loss over template variants and the fitted half of all lines, which weighs as ``share`` lines, whatever its size."""
    raw = [x.encode() for x in texts]
    words = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    some = words.text_end > words.text_start
    best, kept, model.kept = None, model.kept, None
    for _ in range(PASSES):
        g, bias, loss, seen = whole_slope(docs, model, start)
        if not seen:
            break
        g1, bias1, loss1 = slope(model, words, words.text_start[some], words.text_end[some], labels[some])
        weigh = share / seen
        now = (loss * weigh + loss1, model.weights, model.bias, g * weigh + g1, bias * weigh + bias1)
        if best is None or now[0] < best[0]:
            best = now
            kept = kept + best[3] ** 2
        else:
            rate /= 4
        model.weights = (best[1] - rate * best[3] / np.sqrt(kept)).astype(np.float32)
        model.bias = (best[2] - 0.02 * rate * best[4]).astype(np.float32)
    if best:
        model.weights, model.bias = best[1], best[2]
    return model


def calibrate(docs: DataFrame, model: LicenseModel, start: np.ndarray) -> float:
    """The probability that one of ``FALSE_RATE`` of the lines that weren't fitted on reaches with any of its runs, exactly."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, a, b in _blocks(batches, start, False):
            lo, hi = windows(a, b)
            short = b - a <= LONGEST
            lo, hi = np.append(lo, a[short]), np.append(hi, b[short])
            top = np.zeros(len(a))
            np.maximum.at(top, np.searchsorted(a, lo, "right") - 1, shared.value.best(words, lo, hi)[1])
            yield pa.RecordBatch.from_arrays([pa.array(top)], names=["p"])

    tops = docs.mapInArrow(run, "p double").withColumn("g", F.lit(0))
    found = stats.percentiles(tops, "g", "p", {"cut": 1 - FALSE_RATE}).first()
    shared.destroy()
    return max(0.5, found["cut"]) if found else 0.5


def train(docs: DataFrame, text: str = "text") -> LicenseModel:
    """Fit on template variants and on lines that resemble no template, of which one half of all calibrates the cut. ``docs`` is
    read once for each of ``PASSES`` and for the cut; only sums by feature reach the driver."""
    rng = np.random.default_rng(SEED)
    # ids first, so that the choice doesn't carry texts; then the lines of few documents, the first by hash
    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    own = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select(F.explode(F.split(text, "\n")).alias("l")).where("l != ''").select(F.explode(F.transform(F.sequence(F.lit(1), F.length("l"), F.lit(PIECE)), lambda i: F.substring("l", i, F.lit(PIECE)))).alias("l")).distinct()
    lines = sorted(r["l"] for r in own.orderBy(F.xxhash64("l"), "l").limit(SAMPLE_LINES).collect())
    known = {frozenset(_words_of(t)) for ts in TEMPLATES.values() for t in ts}
    other = [x for x in lines if not any(len(k & frozenset(_words_of(x))) >= 0.7 * len(k) for k in known)]
    other = [other[i] for i in rng.permutation(len(other))]
    half = len(other) // 2
    texts, labels = [], []
    for k, f in enumerate(FAMILIES):
        for t in TEMPLATES[f]:
            own = variants(t, rng, 40)
            texts += own
            labels += [k] * len(own)
    model = LicenseModel().fit(texts + other[:half], np.array(labels + [len(FAMILIES)] * half))
    small_batches(docs.sparkSession)
    raw = [x.replace("\n", " ").encode() for x in other[:half]]
    words = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    with np.errstate(over="ignore"):
        start = np.unique([splitmix(words.hash[a:b].sum(keepdims=True))[0] for a, b in zip(words.text_start, words.text_end, strict=True) if b > a]).astype(np.uint64)
    every = docs.select(text)
    refine(every, model, texts, np.array(labels), start, max(1, half))
    model.cut = calibrate(every, model, start)
    return model


FOUND = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("similarity", T.DoubleType())]))


def scan(docs: DataFrame, model: LicenseModel, text: str = "text") -> DataFrame:
    """``docs`` with ``n_paragraphs`` and ``licenses``: the runs of words that pass the calibrated cut, with the line of
    their first word and their similarity to a template. The model has a fixed size and is broadcast."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema.fields if f.name not in ("n_paragraphs", "licenses")]
    schema = T.StructType([*keep, T.StructField("n_paragraphs", T.LongType()), T.StructField("licenses", FOUND)])
    arrow = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            sizes, found = [], []
            for lo, hi, buf, offsets in text_blocks(batch.column(batch.schema.get_field_index(text)), 1 << 18):
                words, starts, row = paragraphs(buf, offsets)
                count = np.bincount(row, minlength=hi - lo)
                first = np.concatenate([[0], np.cumsum(count)])
                rows: list[list] = [[] for _ in range(lo, hi)]
                ends = line_words(words, starts)[1]
                for at, k, chance, share in judge(own, words, starts):
                    i = int(np.searchsorted(ends, at, "right"))
                    rows[row[i]].append({"line": int(i - first[row[i]]), "family": FAMILIES[k], "probability": round(chance, 4), "similarity": round(share, 4)})
                sizes += count.tolist()
                found += rows
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in keep), pa.array(sizes, pa.int64()), pa.array(found, arrow)], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def summary(found: DataFrame, confirm: float = CONFIRM) -> DataFrame:
    sure = F.filter("licenses", lambda x: x["similarity"] >= confirm)
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size(sure).cast("long").alias("n_confirmed"),
        (F.size("licenses") - F.size(sure)).cast("long").alias("n_unconfirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
    )


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return summary(scan(docs, train(docs)))
