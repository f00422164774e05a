"""Licence models are fitted and calibrated on the lines of all documents, not only of the sampled ones."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidalgrid.llm import licenses
from tidalgrid.llm.common import Words

OTHER = len(licenses.FAMILIES)
GUILDS = "weavers potters tanners millers coopers smiths masons glovers fullers cutlers".split()


def near(r) -> str:
    """Much like a notice, but with under 0.7 of any template's words."""
    return f"This work is licensed under the public rules of {r.choice(GUILDS)} and {r.choice(GUILDS)}."


@pytest.fixture(scope="module")
def guilds(spark):
    """The document with the smallest id hash has prose; all others have near notices."""
    r = random.Random(4)
    ids = [x.id for x in spark.range(60).orderBy(F.xxhash64("id")).collect()]
    rows = [(ids[0], "\n".join(" ".join(r.choice(("ta", "mo", "ri", "lu")) + str(i) for _ in range(9)) for i in "abcdefgh"))]
    rows += [(i, "\n".join(near(r) for _ in range(20))) for i in ids[1:]]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def taken(model, lines) -> int:
    raw = [x.encode() for x in lines]
    words = Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return int((model.best(words, words.text_start, words.text_end)[1] >= model.cut).sum())


def test_lines_beyond_the_sample_are_learned(spark, guilds, monkeypatch):
    monkeypatch.setattr(licenses, "SAMPLE_DOCS", 1)
    r = random.Random(5)
    fresh = [near(r) for _ in range(200)]
    model = licenses.train(guilds)
    assert taken(model, fresh) <= 2
    assert taken(model, [t for ts in licenses.TEMPLATES.values() for t in ts]) >= 15


def test_slopes(spark, guilds):
    """The slope agrees with small steps, and the tasks' sum with one pass over all lines, however they are dealt out."""
    model = licenses.LicenseModel()
    rng = np.random.default_rng(1)
    model.weights[:-1] = rng.normal(0, 0.1, (licenses.FEATURES, OTHER + 1))
    raw = "Released under the MIT License. Some other words here".encode()
    words = Words(np.frombuffer(raw, np.uint8), np.array([0, 31, len(raw)]))
    a, b, labels = words.text_start, words.text_end, np.array([licenses.FAMILIES.index("mit"), OTHER])
    g, bias, loss = licenses.slope(model, words, a, b, labels)
    for f, k in [*((int(x), 3) for x in licenses.features(words.hash)[0][:3]), (int(licenses.features(words.hash)[1][1]), 7)]:
        before = model.weights[f, k]
        model.weights[f, k] = before + 0.05
        up = licenses.slope(model, words, a, b, labels)[2]
        model.weights[f, k] = before - 0.05
        assert abs((up - licenses.slope(model, words, a, b, labels)[2]) / 0.1 - g[f, k]) < 1e-3
        model.weights[f, k] = before
    assert abs(bias.sum()) < 1e-6 and loss > 0 and not g[licenses.FEATURES].any()
    none = np.zeros(0, np.uint64)
    text = guilds.select("text")
    lines = [x for t in text.collect() for x in t.text.split("\n")]
    raws = [x.encode() for x in lines]
    words = Words(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)]))
    a, b, key = licenses.pieces(words, np.cumsum([0, *map(len, raws)])[:-1])
    assert len(a) == len(lines)
    own = key & np.uint64(1) == 0
    want = licenses.slope(model, words, a[own], b[own], np.full(own.sum(), OTHER))
    for n in (1, 4):
        got = licenses.whole_slope(text.repartition(n), model, none)
        assert got[3] == own.sum() and abs(got[2] - want[2]) < 1e-2
        assert np.allclose(got[0], want[0], atol=1e-4) and np.allclose(got[1], want[1], atol=1e-4)
    # the other half calibrates
    top = [max(float(x) for x in licenses.LicenseModel.best(model, words, *licenses.windows(a[i : i + 1], b[i : i + 1]))[1]) for i in np.flatnonzero(~own)]
    whole = licenses.LicenseModel.best(model, words, a[~own], b[~own])[1]
    assert abs(licenses.calibrate(text, model, none) - max(0.5, np.quantile(np.maximum(top, whole), 1 - licenses.FALSE_RATE))) < 1e-9


def test_pieces_of_lines(spark):
    """Lines that resemble templates are left out, lines are cut, equal pieces have equal keys, wherever they stand."""
    text = "one two\n\nReleased under the MIT License.\n...\none two\n" + "word " * 900
    buf = np.frombuffer(text.encode(), np.uint8)
    words, starts, _ = licenses.paragraphs(buf, np.array([0, len(buf)]))
    a, b, key = licenses.pieces(words, starts)
    assert (b - a).tolist() == [2, 2, 400, 400, 100]
    assert key[0] == key[1] and key[2] == key[3] != key[4]
    empty = licenses.paragraphs(np.zeros(0, np.uint8), np.array([0, 0]))
    assert [len(x) for x in licenses.pieces(empty[0], empty[1])] == [0, 0, 0]
