"""Line dedup by a segment-partition edit join, with DataFrame functions only.

A line goes if an earlier line of the corpus equals it, or has at most ``EDITS`` edits (in UTF-8 bytes) to it. Lines are
compared without blanks at their ends; blank lines stay. Lines of fewer than ``least`` bytes are compared for equality only, as
a few edits turn any short line into another; 0 compares all. Order is by id, then the text's hash, then the line.

Each distinct line is cut into ``EDITS + 1`` segments, of which one stands unchanged in any line within the threshold, near
its place. Segments are indexed by line length, number and hash; each line probes the places that lengths allow.
A segment that very many lines share is cut out, and what is left of them is partitioned again. Lines that share a key are
compared in blocks of bounded size, within arrays, so no rows of pairs arise. A pair must pass a thresholded distance and is
then measured by a banded bit-parallel pass.

Null texts have no lines and stay null; empty texts have one blank line. Rows without an id come last in the order. Rows that
repeat id and text are one document and each get its result. Extra columns stay; texts are replaced in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalgrid.llm.common import discard, materialize, plain_unions

EDITS, LEAST_BYTES = 2, 24
#: Lines of one block of a comparison.
BLOCK = 64
#: Rows of a key that are refined by the rests of their lines, where these have so many bytes.
HOT, SHORT = 256, 24


def probes(edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(bytes that the indexed line is shorter, segment, shift) that can match within the threshold."""
    return [(d, i, s) for d in range(edits + 1) for i in range(edits + 1) for s in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)]


def banded(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Edit distance of two binaries with at most ``edits`` bytes difference in length, if at most ``edits``; else more.

    Bit k of a word stands for row j - edits + k of the matrix's column j, so one word holds the band, which moves down a
    row with each byte of the shorter binary.
    """
    width = 2 * edits + 1
    full, bottom = (1 << width) - 1, 1 << (width - 1)
    long, short = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    n, m = F.length(long), F.length(short)

    def step(s: Column, j: Column) -> Column:
        c = F.substring(short, j, F.lit(1))
        equal = [F.when((j - edits + k >= 1) & (F.substring(long, F.greatest(j - edits + k, F.lit(1)), F.lit(1)) == c), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(width)]
        match = equal[0]
        for e in equal[1:]:
            match = match.bitwiseOR(e)
        vp, vn = s["vp"], s["vn"]
        d0 = (match.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(match).bitwiseOR(vn).bitwiseAND(F.lit(full))
        hp = vn.bitwiseOR(F.lit(full).bitwiseXOR(d0.bitwiseOR(vp)))
        hn = d0.bitwiseAND(vp)
        down = F.shiftright(d0, 1)
        # in the band's corner the distance grows along the diagonal; past the long line's end along its last row
        edge = F.call_function("shiftright", F.lit(bottom).cast("long"), (j - (n - edits)).cast("int"))
        step_ = F.when(j <= n - edits, F.when(d0.bitwiseAND(F.lit(bottom)) != 0, 0).otherwise(1)).otherwise(
            F.when(hp.bitwiseAND(edge) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(edge) != 0, 1).otherwise(0)
        )
        return F.struct(
            hn.bitwiseOR(F.lit(full).bitwiseXOR(down.bitwiseOR(hp))).bitwiseAND(F.lit(full)).alias("vp"),
            down.bitwiseAND(hp).alias("vn"),
            (s["dist"] + step_).cast("int").alias("dist"),
        )

    start = F.struct(F.lit(full ^ ((1 << edits) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(n, F.lit(edits)).cast("int").alias("dist"))
    return F.aggregate(F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>")), start, step, lambda s: F.when(m > 0, s["dist"]).otherwise(n))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _common(a: Column, b: Column, part) -> Column:
    """Length of the longest equal ends that ``part(x, length)`` cuts, found bit by bit."""
    steps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    limit = F.least(F.length(a), F.length(b))
    return F.aggregate(steps, F.lit(0), lambda n, h: F.when((n + h <= limit) & (part(a, n + h) == part(b, n + h)), n + h).otherwise(n))


def trimmed_distance(a: Column, b: Column, edits: int = EDITS) -> Column:
    """``banded`` after equal beginnings and ends are cut off, which don't change the distance."""
    tail = lambda x, n: F.substring(x, F.length(x) - n + 1, n)

    def inner(x: Column) -> Column:
        return _let(_common(x["a"], x["b"], tail), lambda q: banded(F.substring(x["a"], F.lit(1), F.length(x["a"]) - q), F.substring(x["b"], F.lit(1), F.length(x["b"]) - q), edits))

    head = _common(a, b, lambda x, n: F.substring(x, F.lit(1), n))
    return _let(head, lambda p: _let(F.struct(F.substring(a, p + 1, F.length(a)).alias("a"), F.substring(b, p + 1, F.length(b)).alias("b")), inner))


DOCUMENT = ["none", "id", "hash"]


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """A document's place in the order (no id, id, text hash), its text, and its row as a struct that no name clashes with."""
    whole, own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.col(f"`{text}`")
    return docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"), F.xxhash64(own).alias("hash"), own.alias("text"), whole.alias("row"))


def _trimmed(line: Column) -> Column:
    return F.trim(line)


def first_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(h, g, at, b): each distinct non-blank line by two hashes, its first place and its bytes."""
    lines = _keyed(docs, text).select(*DOCUMENT, F.posexplode(F.split("text", "\n")).alias("line", "own")).select(*DOCUMENT, "line", _trimmed(F.col("own")).alias("own")).where("own != ''")
    first = lines.select(F.xxhash64("own").alias("h"), F.xxhash64(F.lit(7), "own").alias("g"), F.struct(F.struct(*DOCUMENT, "line").alias("at"), "own").alias("x"))
    return first.groupBy("h", "g").agg(F.min("x").alias("x")).select("h", "g", "x.at", F.col("x.own").cast("binary").alias("b"))


def _spots(edits: int) -> list[tuple[bool, int, int, int]]:
    """(whether indexed, bytes that the indexed line is shorter, segment, shift) of all segments and probes of a line."""
    return [(True, 0, i, 0) for i in range(edits + 1)] + [(False, *p) for p in probes(edits)]


def placed(rows: DataFrame, edits: int = EDITS) -> DataFrame:
    """``rows`` with what ``spot`` stands for: the line's length times the number of spots, plus the spot's number. ``cut`` and
    ``len`` say where the segment stands in the line itself, and ``rest`` is the length of the indexed line without it."""
    spots = _spots(edits)
    number = F.pmod("spot", F.lit(len(spots))).cast("int")
    known = {name: F.get(F.array(*[F.lit(p[k]) for p in spots]), number) for k, name in enumerate(("index", "d", "i", "s"))}
    rows = rows.withColumns({"n": F.expr(f"cast(spot div {len(spots)} as int)"), **known})
    start, end = F.expr(f"cast(((n - d) * i) div {edits + 1} as int)"), F.expr(f"cast(((n - d) * (i + 1)) div {edits + 1} as int)")
    return rows.withColumns({"cut": start + F.col("s"), "len": end - start}).withColumn("rest", F.expr("n - d - len"))


def asked_segments(lines: DataFrame, edits: int = EDITS, *carried: str) -> DataFrame:
    """Rows (key, h, index, spot) for ``lines`` (base, h, b, and index and d where these are known already): the segments of a
    line as an indexed one, and the places where it asks for segments of lines that are d bytes shorter.

    ``key`` hashes the indexed line's length, the segment's number and its bytes; ``spot`` says where these stand (``placed``).
    """
    spots = _spots(edits)
    numbers = F.array(*[F.lit(k) for k in range(len(spots))])
    if "d" in lines.columns:
        places = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(d).alias("d")) for x, d, _, _ in spots])
        numbers = F.filter(numbers, lambda k: (F.get(places, k)["x"] == F.col("index")) & (F.get(places, k)["d"] == F.col("d")))
    rows = lines.select("base", "h", "b", F.explode(numbers).alias("number"))
    spot = F.octet_length("b").cast("long") * len(spots) + F.col("number")
    rows = placed(rows.select("base", "h", "b", spot.alias("spot")), edits).where("cut >= 0 and cut + len <= n")
    key = F.xxhash64("base", F.col("n") - F.col("d"), "i", F.substring("b", F.col("cut") + 1, F.col("len")))
    return rows.select(key.alias("key"), "h", "index", "spot", *carried)


def shared_segments(lines: DataFrame, edits: int = EDITS, hot: int = HOT) -> DataFrame:
    """(key, h): of ``lines`` (h, b) those that share a segment with another one; all pairs within the threshold share a key.

    A segment that more than ``hot`` rows share is cut out of its lines, and the rests, which have at most as many edits, are
    partitioned in the same way, until keys are small or rests short. So a part that very many lines have in common doesn't
    bring all of them together.
    """
    met, used, rows = None, [], lines.select(F.lit(0).cast("long").alias("base"), "h", "b")
    while True:
        asked = asked_segments(rows, edits, *(["b"] if used else []))
        # minima and maxima are pre-aggregated, so a key that very many rows have sends one row for each task
        keys = asked.groupBy("key").agg(F.max(F.col("index").cast("int")).alias("indexed"), F.min("h").alias("low"), F.max("h").alias("high"), F.count("*").alias("rows"))
        keys = materialize(keys.where("indexed = 1 and low != high").select("key", "rows"), "keys")
        # rows are as narrow as can be, since each line has many
        # and shuffled at every size, never broadcast with few keys and not with more
        own = materialize(asked.drop("index").join(keys.hint("merge"), "key"), "segments")
        used += [keys, own]
        own = placed(own, edits)
        again = (F.col("rows") > hot) & (F.col("rest") >= SHORT)
        last = own.where(~again).select("key", "h")
        met = last if met is None else met.unionByName(last)
        crowded = own.where(again)
        if crowded.isEmpty():
            break
        if "b" not in crowded.columns:
            crowded = crowded.join(lines.select("h", "b"), "h")
        cut = F.concat(F.substring("b", F.lit(1), F.col("cut")), F.substring("b", F.col("cut") + F.col("len") + 1, F.octet_length("b")))
        rows = crowded.select(F.col("key").alias("base"), "h", "index", "d", cut.alias("b"))
    met = materialize(met.distinct(), "met")
    for x in used:
        discard(x)
    return met


#: Letters whose counts tell most lines apart before their distance is taken.
COUNTED = " entairsoh"


def near_lines(firsts: DataFrame, edits: int = EDITS, least: int = LEAST_BYTES) -> DataFrame:
    """(h, g) of the lines of ``first_lines`` that have an earlier line within the threshold, not counting equal ones."""
    long = firsts.where(F.octet_length("b") >= least - edits)
    met = shared_segments(long.select("h", "b"), edits)
    spread = (
        met.join(met.groupBy("key").agg(F.count("*").alias("size")), "key").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("mine", F.pmod("h", F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "h", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    )
    # lines are many at any size: always shuffled, never broadcast with some sizes and not with others
    groups = long.join(spread.hint("shuffle_hash"), "h").groupBy("key", "i", "j").agg(F.collect_list(F.struct("h", "g", "at", "b")).alias("lines")).where(F.size("lines") > 1)

    def shown(x: Column) -> Column:
        s = F.decode(x["b"], "ISO-8859-1")
        counts = F.array(*[F.length(F.replace(s, F.lit(c), F.lit(""))) for c in COUNTED])
        return F.struct(x["h"].alias("h"), x["g"].alias("g"), x["at"].alias("at"), x["b"].alias("b"), F.octet_length(x["b"]).alias("n"), s.alias("s"), counts.alias("counts"))

    def near(x: Column, y: Column) -> Column:
        # without its c's a line of n bytes has n - count(c) left; both differ by two edits' worth at most
        close = F.abs(x["n"] - y["n"]) <= edits
        for k in range(len(COUNTED)):
            close &= F.abs(x["counts"][k] - y["counts"][k]) <= edits
        return (y["at"] < x["at"]) & (F.greatest(x["n"], y["n"]) >= least) & close & (F.levenshtein(x["s"], y["s"], edits) >= 0) & (trimmed_distance(x["b"], y["b"], edits) <= edits)

    groups = groups.select(F.transform("lines", shown).alias("group"))
    hit = F.filter("group", lambda x: F.exists(F.col("group"), lambda y: near(x, y)))
    found = materialize(groups.select(F.explode(F.transform(hit, lambda x: F.struct(x["h"].alias("h"), x["g"].alias("g")))).alias("x")).select("x.h", "x.g").distinct(), "near")
    discard(met)
    return found


def dedup_lines(docs: DataFrame, text: str = "text", edits: int = EDITS, least: int = LEAST_BYTES) -> DataFrame:
    """``docs`` with the kept lines as ``text`` and the counts ``n_lines`` and ``n_removed``; columns of these names are
    replaced, all others stay, whatever their names."""
    plain_unions(docs.sparkSession)
    firsts = materialize(first_lines(docs, text), "lines")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    near = near_lines(firsts, edits, least)
    kept = materialize(firsts.select("h", "g", "at").join(near, ["h", "g"], "left_anti").select("at"), "kept")
    for x in (firsts, near):
        discard(x)
    by_document = kept.select("at.*").groupBy(*DOCUMENT).agg(F.collect_list("line").alias("lines"))
    lines = _keyed(docs.select(*[F.col(f"`{c}`") for c in columns]), text).join(by_document.hint("shuffle_hash"), DOCUMENT, "left").withColumn("all", F.split("text", "\n"))
    blank = F.filter(F.transform("all", lambda x, i: F.when(_trimmed(x) == "", i)), lambda i: i.isNotNull())
    lines = lines.withColumn("keep", F.array_sort(F.concat(blank, F.coalesce("lines", F.array().cast("array<int>")))))
    out = F.when(F.col("text").isNotNull(), F.array_join(F.transform("keep", lambda i: F.get("all", i)), "\n"))
    return lines.select(
        *[out.alias(text) if c == text else F.col(f"row.`{c}`") for c in columns],
        F.coalesce(F.size("all"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("all") - F.size("keep"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = dedup_lines(docs)
    return found.select("doc_id", F.greatest("n_lines", F.lit(0).cast("long")).alias("n_lines"), "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand earlier in the corpus."""
    found = dedup_lines(docs)
    return found.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


ORACLE = """
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS own, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL),
firsts AS (SELECT t, min((doc_id, line)) AS place FROM (SELECT doc_id, line, trim(own, ' ') AS t FROM lines) WHERE t <> '' GROUP BY t),
sized AS (SELECT t, place, strlen(t) AS n, strlen(replace(t, 'e', '')) AS c1, strlen(replace(t, 'n', '')) AS c2, strlen(replace(t, 't', '')) AS c3, strlen(replace(t, 'a', '')) AS c4, strlen(replace(t, ' ', '')) AS c5,
  strlen(replace(t, 'i', '')) AS c6, strlen(replace(t, 'h', '')) AS c7, strlen(replace(t, 'r', '')) AS c8, strlen(replace(t, 'o', '')) AS c9 FROM firsts WHERE strlen(t) >= 22),
near AS (SELECT DISTINCT x.t FROM (SELECT *, unnest(range(n - 2, n + 3)) AS m FROM sized) x JOIN sized y ON x.m = y.n
  WHERE y.place < x.place AND greatest(x.n, y.n) >= 24 AND abs(x.n - y.n) <= 2
    AND abs((x.n - x.c1) - (y.n - y.c1)) <= 2 AND abs((x.n - x.c2) - (y.n - y.c2)) <= 2 AND abs((x.n - x.c3) - (y.n - y.c3)) <= 2 AND abs((x.n - x.c4) - (y.n - y.c4)) <= 2 AND abs((x.n - x.c5) - (y.n - y.c5)) <= 2
    AND abs((x.n - x.c6) - (y.n - y.c6)) <= 2 AND abs((x.n - x.c7) - (y.n - y.c7)) <= 2 AND abs((x.n - x.c8) - (y.n - y.c8)) <= 2 AND abs((x.n - x.c9) - (y.n - y.c9)) <= 2
    AND levenshtein(x.t, y.t) <= 2),
kept AS (SELECT l.doc_id, l.line, l.own FROM lines l LEFT JOIN firsts f ON trim(l.own, ' ') = f.t
  WHERE trim(l.own, ' ') = '' OR ((l.doc_id, l.line) = f.place AND f.t NOT IN (SELECT t FROM near))),
whole AS (SELECT doc_id, count(*) AS k, string_agg(own, chr(10) ORDER BY line) AS kept FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, (coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(k, 0))::BIGINT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN whole USING (doc_id)
"""
