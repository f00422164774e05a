"""Globs, comparisons, templates, durations."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidalgrid.functions import compare, glob, template
from tidalgrid.operators import catalog
from tidalgrid.sources import registry

TRUE = [
    ("dispositivo_001/temperatura", "dispositivo_001/*"), ("dispositivo_001/temperatura", "*/temperatura"), ("dispositivo_001/temperatura", "*"),
    ("dispositivo_001/temperatura/extra", "dispositivo_001/*"), ("dispositivo1/temperatura", "dispositivo*/temp*"), ("sensor_abc/valor_xyz", "sensor_*/valor_*"),
    ("a", "a/*"), ("a/b/c/d", "*/*"), ("ab", "a?"), ("a1", "a[0-9]"), ("ax", "a[^0-9]"), ("a*b", r"a\*b"), ("a", "a"), ("x", "[^]"),
]
FALSE = [("dispositivo_001/temperatura", "dispositivo_002/*"), ("a/b/c", "a/b"), ("a/b", "a/b/c"), ("sensor1/temp", "dispositivo*/*"), ("a/b", "a?b"), ("a", "[a"), ("a", "a\\"), ("a/b", "a*"), ("b", "[a-"), ("a", "")]


def java(pattern: str) -> str:
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), glob.to_regex(pattern))


@pytest.mark.parametrize(("path", "pattern"), TRUE)
def test_glob_true(spark, path, pattern):
    if pattern == "[^]":
        return
    assert spark.range(1).select(F.lit(path).rlike(glob.to_regex(pattern))).first()[0]


@pytest.mark.parametrize(("path", "pattern"), FALSE)
def test_glob_false(spark, path, pattern):
    assert not spark.range(1).select(F.lit(path).rlike(glob.to_regex(pattern))).first()[0]


def segments(path: str, pattern: str) -> bool:
    """Segment by segment, for globs of letters and ``*``."""
    p, s = pattern.split("/"), path.split("/")
    one = lambda a, b: re.fullmatch(a.replace("*", "[^/]*"), b) is not None
    if p[-1] == "*":
        return len(s) >= len(p) - 1 and all(one(a, b) for a, b in zip(p[:-1], s, strict=False))
    return len(p) == len(s) and all(one(a, b) for a, b in zip(p, s, strict=True))


@given(st.from_regex(r"[ab]{1,2}(/[ab]{1,2}){0,3}", fullmatch=True), st.from_regex(r"[ab*]{1,2}(/[ab*]{1,2}){0,3}", fullmatch=True))
def test_glob_segments(path, pattern):
    if pattern != "*":
        assert (re.search(java(pattern), path) is not None) == segments(path, pattern)


def test_regex_of_a_column(spark):
    """The column's expressions match what ``to_regex`` matches."""
    r = random.Random(5)
    globs = [p for _, p in TRUE + FALSE] + ["/*", "*/", "[a/b]/*", "[a/b]", "a\\/*", "[^]a]", "[z-a]*", "[^z-a]", r"[\]-\^]*", "[[]*", "é日*", "[é-日]*", "🙂?", "a.b/*", "[^^]*", "a\nb*", "[a-]", "[-a]", "[a-b-c]"]
    globs += ["".join(r.choice("aab-]^[*?\\//é") for _ in range(r.randint(0, 8))) for _ in range(1500)]
    paths = [p for p, _ in TRUE + FALSE] + ["", "/", "a/", "aab", "a/b", "a\nb", "é", "日", "🙂x", "[a", "^", "]", "-", "a.b", "axb", "/a", "\\"]
    paths += ["".join(r.choice("aab/é]^-") for _ in range(r.randint(1, 5))) for _ in range(60)]
    known = spark.createDataFrame([(g, glob.to_regex(g)) for g in sorted(set(globs))], "glob string, known string")
    both = known.withColumn("own", glob.regex_of(F.col("glob"))).crossJoin(spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string"))
    both = both.withColumn("want", F.rlike("path", F.col("known"))).withColumn("head", glob.literal_head(F.col("glob")))
    assert both.where("want").count() > 500
    assert both.where(F.rlike("path", F.col("own")) != F.col("want")).collect() == []
    assert both.where(F.col("want") & (F.col("head") != glob.first_segment(F.col("path")))).collect() == []


def test_query_pattern_without_star_is_exact(spark):
    paths = spark.createDataFrame([("a?",), ("ab",)], "path string")
    assert [r.path for r in paths.where(glob.selects(F.col("path"), "a?")).collect()] == ["a?"]
    assert paths.where(glob.matches(F.col("path"), "a?")).count() == 2
    assert paths.where(glob.matches(F.col("path"), "")).count() == 2


CASES = [
    ({"number": 10.0}, ">", {"number": 5.0}, True), ({"number": 10.0}, "==", {"number": 10.0}, True), ({"number": 1.0}, "==", {"number": 1.0 + 1e-10}, True),
    ({"text": "TEXTO"}, "==", {"text": "texto"}, True), ({"bool": True}, "!=", {"bool": False}, True), ({"bool": True}, ">", {"bool": False}, False), ({"text": "a"}, ">", {"text": "b"}, False),
    ({"bool": True}, "==", {"text": "true"}, False), ({"text": "texto"}, "==", {"number": 42.0}, False), ({"number": float("nan")}, "==", {"number": float("nan")}, False),
    ({"number": float("nan")}, ">", {"number": 1.0}, False), ({}, "==", {}, False), ({"number": 1.0}, "~", {"number": 1.0}, False), ({"number": float("inf")}, "==", {"number": float("inf")}, True),
]


@pytest.mark.parametrize(("a", "op", "b", "want"), CASES)
def test_compare(spark, a, op, b, want):
    kinds = {"number": "double", "bool": "boolean", "text": "string"}
    cols = lambda x: {k: F.lit(x.get(k)).cast(t) for k, t in kinds.items()}
    assert spark.range(1).select(compare.compare(cols(a), F.lit(op), cols(b))).first()[0] is want


def test_templates(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    params = F.create_map(F.lit("tipo_actuador"), F.lit("ventilador"), F.lit("serie_0"), F.lit("nodo_03"))
    assert one(template.resolve(F.lit("actuadores/{serie_0}/{tipo_actuador}"), params, F.lit("r"), F.lit("n"), F.lit("x/y"))) == "actuadores/nodo_03/ventilador"
    assert one(template.resolve(F.lit("actuadores/{nodo_id}/{inexistente}"), F.create_map(F.lit("nodo_id"), F.lit("nodo_01")), F.lit("r"), F.lit("n"), F.lit("x"))) == "actuadores/nodo_01/"
    assert one(template.resolve(F.lit("{serie}:{serie_1}:{serie_5}:{regla_id}"), F.lit(None).cast("map<string,string>"), F.lit("r"), F.lit("n"), F.lit("x/y"))) == "x/y:y::r"
    assert one(template.variables(F.lit("{a}/{b}/{a}"))) == ["a", "b"]
    assert [one(template.valid(F.lit(t))) for t in ("a/{b}", "{", "}", "{}", "{{a}}", "{1a}", "x")] == [True, False, False, False, False, False, True]
    assert one(template.missing(F.lit("{a}/{serie_2}/{c}"), F.create_map(F.lit("a"), F.lit("1")))) == ["c"]


def test_durations(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(registry.duration_ns(F.lit("1h5m0.5s"))) == 3_900_500_000_000
    assert one(registry.duration_ns(F.lit("5m0s"))) == 300_000_000_000
    assert one(registry.duration_ns(F.lit("soon"))) is None
    assert [one(registry.duration_text(F.lit(n))) for n in (300_000_000_000, 3_900_500_000_000, 500_000_000)] == ["5m0s", "1h5m0.5s", "0.5s"]


def test_codecs_and_paths(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(catalog.codec_allowed(F.lit("Integer"), F.lit("Bits")))
    assert not one(catalog.codec_allowed(F.lit("Real"), F.lit("Bits")))
    assert one(catalog.codec_allowed(F.lit("?"), F.lit("None")))
    assert [one(catalog.path_valid(F.lit(p))) for p in ("a/b-1", "/a", "a/", "a//b", "", "a b", None)] == [True, False, False, False, False, False, False]
