"""Encodings as DataFrame transforms with size estimates, per series and block of arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalgrid import schema
from tidalgrid.operators import windows

KEY = ["node_id", "path"]
MAX_RUN, MAX_DICTIONARY = 255, 65_535


def _order(by: list[str]):
    return Window.partitionBy(*by).orderBy("seq")


def runs(rows: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """Run lengths of equal consecutive values in arrival order, at most 255 each: ``run, value, n, first_seq``. Runs pass from
    slab to slab of arrival order by carries (see ``windows``)."""
    by = by or KEY
    return _runs(windows.dealt(rows.select(*by, "seq", F.col(value).alias("value")), by), by)


def _runs(rows: DataFrame, by: list[str]) -> DataFrame:
    """``runs`` of ``value`` of rows that are dealt."""
    own = windows.numbered(rows, by, "_place")
    marked = windows.lagged(own, by, "value", "_before", "_first").withColumn("_new", F.col("_first") | ~F.col("value").eqNullSafe(F.col("_before")))
    begun = windows.carried(marked, by, ["seq"], F.max, F.when(F.col("_new"), F.col("_place")), "_open")
    # a run that is too long is cut, so its rows are counted from its first one
    inside = F.when(F.col("_new"), 0).otherwise(F.col("_place") - F.col("_open"))
    opens = (inside % MAX_RUN == 0).cast("long")
    cut = windows.carried(begun.withColumn("_opens", opens), by, ["seq"], F.sum, F.col("_opens"), "_run").withColumn("run", (F.col("_run") + F.col("_opens")).cast("int"))
    return cut.groupBy(*by, "run").agg(F.any_value("value").alias("value"), F.count("*").alias("n"), F.min("seq").alias("first_seq")).select(*by, "run", "value", "n", "first_seq")


def expand(coded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The values back, numbered in order."""
    by = by or KEY
    rows = coded.select(*by, "run", "value", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_i"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy("run", "_i"))).select(*by, "pos", "value")


def width(x: Column) -> Column:
    """Bytes that a signed integer needs: 1, 2, 4 or 8."""
    return F.when(x.between(-128, 127), 1).when(x.between(-32768, 32767), 2).when(x.between(-2147483648, 2147483647), 4).otherwise(8)


def delta_of_delta(rows: DataFrame, value: str = "ts_ns", by: list[str] | None = None) -> DataFrame:
    """``pos`` and ``dod``: the first value, then the first difference, then differences of differences; ``bytes`` each needs."""
    by = by or KEY
    return _delta_of_delta(windows.dealt(rows.select(*by, "seq", F.col(value).alias("_own")), by), by)


def _delta_of_delta(rows: DataFrame, by: list[str]) -> DataFrame:
    """``delta_of_delta`` of ``_own`` of rows that are dealt."""
    own = windows.numbered(rows, by, "_place")
    d = windows.lagged(own, by, "_own", "_before", "_first").withColumn("pos", (F.col("_place") + 1).cast("int")).withColumn("_d", F.col("_own") - F.col("_before"))
    d = windows.lagged(d, by, "_d", "_last", "_none")
    dod = F.when(F.col("pos") == 1, F.col("_own")).when(F.col("pos") == 2, F.col("_d")).otherwise(F.col("_d") - F.col("_last"))
    return d.withColumn("dod", dod).select(*by, "seq", "pos", "dod", width(F.col("dod")).alias("bytes"))


def undo_delta_of_delta(coded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The values back, by two running sums."""
    by = by or KEY
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    delta = F.sum(F.when(F.col("pos") == 1, 0).otherwise(F.col("dod"))).over(w)
    first = F.sum(F.when(F.col("pos") == 1, F.col("dod")).otherwise(0)).over(w)
    one = coded.withColumn("_d", delta).withColumn("_f", first)
    return one.withColumn("value", F.col("_f") + F.sum(F.when(F.col("pos") == 1, 0).otherwise(F.col("_d"))).over(w)).select(*by, "seq", "pos", "value")


def dictionary(rows: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """``id`` of each row's value, numbered by first appearance from 0; null beyond the dictionary's limit."""
    by = by or KEY
    first = rows.groupBy(*by, value).agg(F.min("seq").alias("_first"))
    ids = first.withColumn("id", F.row_number().over(Window.partitionBy(*by).orderBy("_first")) - 1).withColumn("id", F.when(F.col("id") < MAX_DICTIONARY, F.col("id")))
    b = ids.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(value).alias("_value"), "id")
    on = F.col(value).eqNullSafe(F.col("_value"))
    for c in by:
        on &= F.col(c) == F.col(f"_{c}")
    return rows.join(b, on).select(*by, "seq", value, "id")


def dictionary_blocks(rows: DataFrame, value: str = "value", size: int = schema.MAX_BLOCK_SIZE, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Each block of ``size`` rows by its own dictionary: the entries (``block, id, value``), and the runs of ids
    (``block, run, value`` as the id, ``n, first_seq``)."""
    by = by or KEY
    if not 0 < size <= MAX_DICTIONARY:
        raise ValueError("a block must not have more rows than a dictionary may have entries")
    block = [*by, "block"]
    placed = windows.numbered(windows.dealt(rows.select(*by, "seq", F.col(value).alias("value")), by), by, "_place")
    placed = placed.withColumn("block", F.expr(f"_place div {size}")).drop("slab", "_place")
    # a block is bounded, so its values are numbered where its rows are
    first = placed.withColumn("_first", F.min("seq").over(Window.partitionBy(*block, "value")))
    coded = first.select(*block, "seq", "value", (F.dense_rank().over(Window.partitionBy(*block).orderBy("_first")) - 1).alias("id"))
    entries = coded.groupBy(*block, "id").agg(F.any_value("value").alias("value"))
    return entries, _runs(coded.select(*block, "seq", F.col("id").alias("value")), block)


def undo_dictionary_blocks(entries: DataFrame, coded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The values back: ``block, pos, value``, numbered within each block."""
    own = [*(by or KEY), "block"]
    ids = expand(coded, own).withColumnRenamed("value", "id")
    return ids.join(entries, [*own, "id"]).select(*own, "pos", "value")


def bit_width(rows: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """Smallest and largest value, and the bits of the offsets between; 0 when constant."""
    by = by or KEY
    out = rows.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    return out.withColumn("bits", F.when(F.col("high") == F.col("low"), 0).otherwise(F.length(F.bin(F.col("high") - F.col("low")))))


def xor_profile(rows: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """Leading and trailing zeros and meaningful bits of the XOR of consecutive doubles' bits."""
    by = by or KEY
    raw = F.expr(f"java_method('java.lang.Double', 'doubleToRawLongBits', {value})").cast("long")
    w = _order(by)
    x = rows.select(*by, "seq", raw.alias("_b")).withColumn("_x", F.col("_b").bitwiseXOR(F.lag("_b").over(w))).where("_x is not null")
    text = F.lpad(F.bin("_x"), 64, "0")
    lead = F.when(F.col("_x") == 0, 64).otherwise(F.instr(text, "1") - 1)
    trail = F.when(F.col("_x") == 0, 0).otherwise(F.instr(F.reverse(text), "1") - 1)
    return x.select(*by, "seq", lead.alias("leading"), trail.alias("trailing")).withColumn("meaningful", 64 - F.col("leading") - F.col("trailing"))


def block_advice(rows: DataFrame, size: int = schema.MAX_BLOCK_SIZE) -> DataFrame:
    """Of typed measurements: estimated bytes of each series' block of ``size`` rows under the codecs that its value type
    allows, and the smallest (by name on ties).

    Numbers take 8 bytes, booleans 1, texts their UTF-8 bytes and 2 of length. Reals' second differences are those of their
    bits. Xor is sized without windows of bits that stay from one value to the next. A missing value counts as zero bytes, a
    difference to it as 9, its XOR as 77 bits. More texts than a dictionary holds, or longer ones than its lengths can say, rule it out.
    """
    block = [*KEY, "block"]
    w = Window.partitionBy(*block).orderBy("seq")
    raw = F.expr("java_method('java.lang.Double', 'doubleToRawLongBits', v_double)").cast("long")
    code = F.when(F.col("value_type") == "Integer", F.col("v_long")).when((F.col("value_type") == "Real") & F.col("v_double").isNotNull(), raw)
    plain = F.when(F.col("value_type") == "Boolean", F.when(F.col("v_bool").isNotNull(), 1)).when(F.col("value_type") == "Text", F.octet_length("v_text") + 2).otherwise(F.when(code.isNotNull(), 8))
    placed = windows.numbered(windows.dealt(rows.select(*KEY, "seq", "value_type", "v_double", "v_long", "v_bool", "v_text"), KEY), KEY, "_place")
    x = placed.select(
        *KEY, "seq", "value_type", F.expr(f"_place div {size}").alias("block"),
        code.alias("code"), F.coalesce(plain, F.lit(0)).cast("long").alias("plain"), F.when(F.col("value_type") == "Text", F.col("v_text")).alias("text"), F.struct("value_type", code, "v_bool", "v_text").alias("own"),
    )
    before = F.lag("code").over(w)
    x = x.withColumns({
        "pos": F.row_number().over(w), "d": F.try_subtract(F.col("code"), before), "xor": F.col("code").bitwiseXOR(before),
        "new": (~F.col("own").eqNullSafe(F.lag("own").over(w))).cast("int"), "fresh": F.row_number().over(Window.partitionBy(*block, "text").orderBy("seq")) == 1,
    })
    x = x.withColumns({"dod": F.try_subtract(F.col("d"), F.lag("d").over(w)), "run": F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    bits = F.lpad(F.bin("xor"), 64, "0")
    changed = F.coalesce(F.lit(77) - (F.instr(bits, "1") - 1) - (F.instr(F.reverse(bits), "1") - 1), F.lit(77))
    runs_ = x.groupBy(*block, "value_type", "run").agg(
        F.count("*").alias("n"), F.count("code").alias("coded"), F.max("plain").alias("each"), F.min("code").alias("low"), F.max("code").alias("high"),
        F.sum(F.when(F.col("pos") <= 2, 8).otherwise(width(F.col("dod")) + 1)).alias("dod"),
        F.sum(F.when(F.col("pos") == 1, 96).when(F.col("xor") == 0, 1).otherwise(changed)).alias("xor"),
        F.sum(F.when(F.col("fresh"), F.col("plain")).otherwise(0)).alias("entries"), F.count(F.when(F.col("fresh"), 1)).alias("texts"),
    )
    parts = F.ceil(F.col("n") / MAX_RUN)
    one = runs_.groupBy(*block, "value_type").agg(
        F.sum(F.col("n") * F.col("each")).alias("None"), F.sum(parts * (F.col("each") + 1)).alias("RLE"), F.sum("dod").alias("DeltaDelta"), F.ceil(F.sum("xor") / 8).alias("Xor"),
        F.when((F.sum("texts") <= MAX_DICTIONARY) & (F.max("each") <= MAX_DICTIONARY + 2), F.sum("entries") + F.sum(parts * 3) + 2).alias("Dictionary"),
        F.sum("coded").alias("coded"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    need = F.when(F.col("high") == F.col("low"), 0).otherwise(F.coalesce(F.length(F.bin(F.try_subtract("high", "low"))), F.lit(64)))
    one = one.withColumn("Bits", F.ceil(F.col("coded") * need / 8) + 17)
    codecs = sorted({c for own in schema.VALUE_CODECS.values() for c in own})
    sizes = F.array(*[F.struct(F.when(F.col("value_type").isin([t for t, own in schema.VALUE_CODECS.items() if c in own]), F.col(c)).cast("long").alias("bytes"), F.lit(c).alias("codec")) for c in codecs])
    best = F.array_min(F.filter(sizes, lambda s: s["bytes"].isNotNull()))
    return one.select(*block, "value_type", best.alias("best")).select(*block, "value_type", "best.codec", "best.bytes")


def advice(rows: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """Estimated bytes of integers under each codec, and the smallest (by name on ties)."""
    by = by or KEY
    plain = rows.groupBy(*by).agg((F.count("*") * 8).alias("bytes")).withColumn("codec", F.lit("None"))
    own = windows.dealt(rows.select(*by, "seq", F.col(value).alias("value"), F.col(value).alias("_own")), by)
    rle = _runs(own.drop("_own"), by).groupBy(*by).agg((F.count("*") * 9).alias("bytes")).withColumn("codec", F.lit("RLE"))
    dod = _delta_of_delta(own.drop("value"), by).groupBy(*by).agg(F.sum(F.when(F.col("pos") <= 2, 8).otherwise(F.col("bytes") + 1)).cast("long").alias("bytes")).withColumn("codec", F.lit("DeltaDelta"))
    bits = bit_width(rows, value, by).select(*by, (F.ceil(F.col("n") * F.col("bits") / 8) + 17).cast("long").alias("bytes")).withColumn("codec", F.lit("Bits"))
    sizes = plain.unionByName(rle).unionByName(dod).unionByName(bits)
    return sizes.groupBy(*by).agg(F.min_by("codec", F.struct("bytes", "codec")).alias("codec"), F.min("bytes").alias("bytes"))
