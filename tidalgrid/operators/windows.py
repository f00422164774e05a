"""Sliding windows over series: folds by panes, arrival order, running sums by slabs.

``folded`` answers what a closed window ``[t - w, t]`` of a series holds. Time is cut into panes of ``w + 1``, so a window is the
end of one pane and the beginning of the next; running folds from either side of each pane give both, and no row is folded
again for another window. Sums are only added up, never subtracted. A series is spread over as many groups as it has panes.

Where arrival counts, an ask is a row's place ``(t_ns, seq)``, and a row counts if its time is in the window and it arrived no later.
Rows that arrived after none with a later time are punctual: for these the order of ``(t_ns, seq)`` tells all. The late ones of a
series are numbered by arrival, and the first ``c`` of them are at most one block of 2^l rows for each bit of ``c``; blocks are
folded by panes like everything else, and the answers of all blocks and of the punctual rows are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalgrid import schema

SERIES = ["node_id", "path"]
#: A condition without an aggregate looks at the last value.
LAST = "last"
#: The ends of arrival order.
FIRST_SEQ, LAST_SEQ = -(1 << 63), (1 << 63) - 1
#: Spans that a large key is cut into, rows that make a key large, and rows of a task.
SLABS, HOT, EACH = 256, 1 << 18, 1 << 18


def pane(width: int, column: str = "t_ns") -> Column:
    """The number of the pane of ``width`` that a time lies in; exact for all longs."""
    return F.expr(f"({column} - pmod({column}, {width}L)) div {width}L")


def dealt(rows: DataFrame, keys: list[str], column: str = "seq") -> DataFrame:
    """``rows`` dealt to tasks of about ``EACH`` rows by ``keys``. Where a key has more than ``HOT`` rows there is a column ``slab``: of
    such keys one of ``SLABS`` equal spans of ``column``, of all others -1. So a key that is not large is put in order once,
    without carries, and the rows of a task don't grow with the input."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
    hot = F.collect_list(F.when(F.col("n") > HOT, F.struct(*keys, "low", (F.expr(f"(high - low) div {SLABS}L") + 1).alias("width"))))
    total, large = sizes.agg(F.sum("n"), hot).first()
    if large:
        wide = rows.sparkSession.createDataFrame([tuple(r) for r in large], sizes.select(*keys, F.col("low").cast("long"), F.col("high").cast("long").alias("width")).schema)
        spans = wide.select(*[F.col(c).alias(f"_{c}") for c in keys], "low", "width")
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
        slab = F.coalesce(F.expr(f"({column} - low) div width"), F.when(F.col("width").isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long"))
        rows = rows.join(F.broadcast(spans), on, "left").select(*rows.columns, slab.alias("slab"))
    if (total or 0) <= EACH:
        return rows
    return rows.repartition(-(-total // EACH), *keys, *(["slab"] if large else []))


def _parts(rows: DataFrame, keys: list[str]) -> list[str]:
    return [*keys, "slab"] if "slab" in rows.columns else keys


def _with_ends(rows: DataFrame, ends: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with ``name`` from ``ends``, which has few rows for each large key and slab."""
    few = ends.select(*[F.col(c).alias(f"_{c}") for c in [*keys, "slab"]], name)
    return rows.join(F.broadcast(few), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*keys, "slab"]], "left").select(*rows.columns, name)


def carried(rows: DataFrame, keys: list[str], order: list[str], fold, value: Column, name: str) -> DataFrame:
    """A running fold of ``value`` by ``keys`` along ``order``, the row's own value excluded. Rows that are ``dealt`` with slabs are
    folded within each slab, and slabs from their totals, so no key is one task. ``fold`` is max or sum."""
    own = rows.withColumn("_v", value)
    local = fold("_v").over(Window.partitionBy(*_parts(rows, keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    both, carry = own.withColumn("_local", local), F.lit(None)
    if "slab" in rows.columns:
        before = Window.partitionBy(*keys).orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
        totals = own.where("slab >= 0").groupBy(*keys, "slab").agg(fold("_v").alias("_all")).select(*keys, "slab", fold("_all").over(before).alias("_carry"))
        both, carry = _with_ends(both, totals, keys, "_carry"), F.col("_carry")
    merged = F.greatest(carry.cast("long"), "_local") if fold is F.max else F.coalesce(carry, F.lit(0)) + F.coalesce("_local", F.lit(0))
    return both.withColumn(name, merged).drop("_v", "_carry", "_local")


def numbered(rows: DataFrame, keys: list[str], name: str, order: list[str] | None = None) -> DataFrame:
    """``rows`` (see ``dealt``) with ``name``, a row's place by ``keys`` in arrival order, from 0."""
    return carried(rows, keys, order or ["seq"], F.sum, F.lit(1).cast("long"), name)


def lagged(rows: DataFrame, keys: list[str], value: str, name: str, first: str, order: list[str] | None = None) -> DataFrame:
    """``rows`` (see ``dealt``) with ``name``, the ``value`` of the row before by ``keys`` in arrival order, and ``first``, whether there
    is none. The first row of a slab gets the last value of the slab before."""
    order, held = order or ["seq"], F.struct(F.col(value).alias("v"))
    both = rows.withColumn("_end", F.lag(held).over(Window.partitionBy(*_parts(rows, keys)).orderBy(*order)))
    if "slab" in rows.columns:
        ends = rows.where("slab >= 0").groupBy(*keys, "slab").agg(F.max_by(held, F.struct(*order)).alias("_last"))
        ends = ends.select(*keys, "slab", F.lag("_last").over(Window.partitionBy(*keys).orderBy("slab")).alias("_last_end"))
        both = _with_ends(both, ends, keys, "_last_end").withColumn("_end", F.coalesce("_end", "_last_end")).drop("_last_end")
    return both.withColumn(name, F.col("_end.v")).withColumn(first, F.col("_end").isNull()).drop("_end")


def values(meas: DataFrame) -> DataFrame:
    """Measurements as rows (node_id, path, t_ns, seq, num, bool, text), and ``late`` if they have it."""
    return meas.select("node_id", "path", F.col("ts_ns").alias("t_ns"), "seq", schema.v_num().alias("num"), F.col("v_bool").alias("bool"), F.col("v_text").alias("text"), *[c for c in ("late",) if c in meas.columns])


def mark_late(meas: DataFrame) -> DataFrame:
    """Measurements with ``late``: whether a row of the same node with a later time had arrived before."""
    rows = carried(dealt(meas, ["node_id"]), ["node_id"], ["seq", "ts_ns"], F.max, F.col("ts_ns"), "_newest")
    return rows.withColumn("late", F.coalesce(F.col("ts_ns") < F.col("_newest"), F.lit(False))).select(*meas.columns, "late")


def _folds(agg: str) -> dict[str, tuple[Column, object]]:
    """Name -> (value of a row, how values are merged) of what an aggregate needs; ``n`` counts rows that it sees."""
    count = F.when(F.col("num").isNotNull(), F.lit(1).cast("long"))
    if agg == LAST:
        # of equal times the first arrived
        return {"v": (F.struct("t_ns", (-F.col("seq")).alias("r"), "num", "bool", "text"), F.max)}
    own = {"max": ("num", F.max), "min": ("num", F.min), "avg": ("num", F.sum), "sum": ("num", F.sum)}.get(agg)
    return {"n": (count, F.sum)} | ({"v": (F.col(own[0]), own[1])} if own else {})


def folded(rows: DataFrame, asks: DataFrame, keys: list[str], window_ns: int, agg: str) -> DataFrame:
    """(keys, t_ns, seq, parts...): what each ask's window holds, in one or two rows that ``answers`` merges. ``asks`` has keys, t_ns,
    seq and ``until``: rows of the ask's time count if their ``seq`` is no larger than that."""
    width, parts = window_ns + 1, _folds(agg)
    name = list(parts)
    held = rows.select(*keys, pane(width).alias("pane"), F.col("t_ns").alias("at"), F.col("seq").alias("order"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("t_ns"), F.lit(None).cast("long").alias("seq"), *[v.alias(n) for n, (v, _) in parts.items()])
    kinds = {f.name: f.dataType for f in held.schema}
    # an ask at the end of its pane sees the pane alone
    sides = F.array(F.struct(F.lit(1).alias("kind"), pane(width).alias("pane"), F.col("t_ns").alias("at")), F.when(F.expr(f"pmod(t_ns, {width}L) != {window_ns}L"), F.struct(F.lit(2).alias("kind"), (pane(width) - 1).alias("pane"), (F.col("t_ns") - window_ns).alias("at"))))
    looked = asks.select(*keys, "t_ns", "seq", "until", F.inline(F.array_compact(sides))).select(*keys, "pane", "at", F.col("until").alias("order"), "kind", "t_ns", "seq", *[F.lit(None).cast(kinds[n]).alias(n) for n in name])
    both = held.unionByName(looked)
    ahead = Window.partitionBy(*keys, "pane").orderBy("at", "order", "kind").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys, "pane").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.select(*keys, "kind", "t_ns", "seq", *[f(n).over(ahead).alias(f"a_{n}") for n, (_, f) in parts.items()], *[f(n).over(back).alias(f"b_{n}") for n, (_, f) in parts.items()])
    return both.where("kind > 0").select(*keys, "t_ns", "seq", *[F.when(F.col("kind") == 1, F.col(f"a_{n}")).otherwise(F.col(f"b_{n}")).alias(n) for n in name])


def answers(parts: DataFrame, agg: str) -> DataFrame:
    """(node_id, path, t_ns, seq, num, bool, text, some): the merged parts of each ask; ``some`` tells whether its window has data."""
    merged = parts.groupBy(*SERIES, "t_ns", "seq").agg(*[f(n).alias(n) for n, (_, f) in _folds(agg).items()])
    return merged.select(*SERIES, "t_ns", "seq", *_answer(agg))


def _answer(agg: str) -> list[Column]:
    """``num, bool, text, some`` of merged parts."""
    if agg == LAST:
        return [F.col("v.num"), F.col("v.bool"), F.col("v.text"), F.col("v").isNotNull().alias("some")]
    none = F.lit(None).cast("double")
    number = {"avg": F.col("v") / F.col("n"), "count": F.coalesce("n", F.lit(0)).cast("double")}.get(agg, F.col("v").cast("double") if agg in schema.AGGREGATES else none) if agg in schema.AGGREGATES else none
    return [number.alias("num"), F.lit(None).cast("boolean").alias("bool"), F.lit(None).cast("string").alias("text"), (F.coalesce("n", F.lit(0)) > 0).alias("some")]


def arrivals(rows: DataFrame, keys: list[str], keep: list[str], agg: str) -> DataFrame:
    """(keys, seq, keep..., num, bool, text, some): what ``rows`` of a key hold after each arrival."""
    order, parts = Window.partitionBy(*keys).orderBy("seq").rangeBetween(Window.unboundedPreceding, 0), _folds(agg)
    named = rows.select(*keys, "seq", *keep, *[v.alias(n) for n, (v, _) in parts.items()])
    return named.select(*keys, "seq", *keep, *[f(n).over(order).alias(n) for n, (_, f) in parts.items()]).select(*keys, "seq", *keep, *_answer(agg))


def late_asks(late: DataFrame, asks: DataFrame, window_ns: int) -> DataFrame:
    """Asks (node_id, t_ns, seq) of the series whose windows hold late rows, by panes."""
    width = window_ns + 1
    near = late.select(*SERIES, F.explode(F.array(pane(width), pane(width) + 1)).alias("pane")).distinct()
    return asks.withColumn("pane", pane(width)).join(near, ["node_id", "pane"]).select(*SERIES, "t_ns", "seq")


def late_folded(late: DataFrame, asks: DataFrame, window_ns: int, agg: str) -> DataFrame:
    """``folded`` for late rows and asks (node_id, path, t_ns, seq): only rows that arrived no later than the ask count."""
    order = Window.partitionBy(*SERIES).orderBy("seq", "t_ns")
    ranked = late.withColumn("rank", F.row_number().over(order).cast("long") - 1).withColumn("size", F.count("*").over(Window.partitionBy(*SERIES)))
    bits = lambda x: F.sequence(F.lit(0), F.length(F.bin(x)) - 1)
    blocks = ranked.withColumn("level", F.explode(bits(F.col("size")))).withColumn("block", F.expr("shiftright(rank, level)")).where("block % 2 = 0")
    spots = late.select(*SERIES, F.lit(None).cast("long").alias("t_ns"), "seq").unionByName(asks.select(*SERIES, "t_ns", "seq"))
    arrived = F.count_if(F.col("t_ns").isNull()).over(Window.partitionBy(*SERIES).orderBy("seq").rangeBetween(Window.unboundedPreceding, 0))
    seen = spots.withColumn("c", arrived).where("t_ns is not null and c > 0")
    looked = seen.withColumn("level", F.explode(bits(F.col("c")))).where("shiftright(c, level) % 2 = 1").withColumn("block", F.expr("2 * shiftright(c, level + 1)"))
    # all rows of such a block have arrived, whatever their number
    return folded(blocks, looked.withColumn("until", F.lit(LAST_SEQ)), [*SERIES, "level", "block"], window_ns, agg).drop("level", "block")


def look(rows: DataFrame, asks: DataFrame, window_ns: int, agg: str) -> DataFrame:
    """The answers to ``asks`` (node_id, path, t_ns, seq) over ``rows`` (see ``values``). With a column ``late`` arrival counts;
    else an ask's ``seq`` only tells which rows of its own time it sees."""
    asks = asks.withColumn("until", F.col("seq"))
    if "late" not in rows.columns:
        return answers(folded(rows, asks, SERIES, window_ns, agg), agg)
    parts = folded(rows.where("not late"), asks, SERIES, window_ns, agg)
    return answers(parts.unionByName(late_folded(rows.where("late"), asks, window_ns, agg)), agg)
