"""Totals of rule firings over inserted rows in arrival order, without a row for each firing.

Inserts are points: their rank by time and their rank by arrival. A row of a condition's series is seen by the inserts
from its time to the end of its window that arrived no earlier. So the rows of a rule cut time into slabs, and within a slab the
condition changes only where one of the slab's rows arrives: a rule fires in rectangles, whose number grows with the rule's rows and
those in a window, whatever the number of inserts.

A rectangle's points are counted from its corners. A point lies past a corner's rank by time if at one binary digit it has 1 and the
corner 0, and all higher digits agree; so each level of digits is a running sum by arrival. The first firings are looked for from a
rule's first rectangle on, a few inserts at first and ever more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalgrid import session
from tidalgrid.operators import rules as rules_
from tidalgrid.operators import windows
from tidalgrid.operators.windows import FIRST_SEQ, LAST

#: What a condition compares with, and what it belongs to.
FIELDS = ["rule", "logic", "size", "pos", "op", "t_double", "t_long", "t_bool", "t_text", "agg", "window_ns"]


def _swapped(times: DataFrame) -> DataFrame:
    """``times`` with arrival in the place of time."""
    return times.select("node_id", F.col("seq").alias("t_ns"), F.col("t_ns").alias("seq"))


def places(times: DataFrame) -> DataFrame:
    """(node_id, t_ns, seq, p, q): the ranks of a node's inserts by time and by arrival, from 0."""
    by_time = rules_.numbered_times(times).withColumnRenamed("rank", "p")
    by_seq = rules_.numbered_times(_swapped(times)).select("node_id", F.col("seq").alias("t_ns"), F.col("t_ns").alias("seq"), F.col("rank").alias("q"))
    return session.keep(by_time.join(by_seq, ["node_id", "t_ns", "seq"]), "places")


def areas(meas: DataFrame, series: DataFrame, conditions: DataFrame, numbers: DataFrame, times: DataFrame) -> DataFrame:
    """(node_id, rule, p1, p2, q1, q2): the rectangles of ranks in which a rule fires; its conditions read one series each. ``numbers``
    (node_id, rule_id, logic, size, rule) names the rules."""
    bound = rules_.bind(conditions, series).where("window_ns >= 0").drop("path").withColumnRenamed("series_path", "path")
    own = bound.join(numbers, ["node_id", "rule_id", "logic"]).join(windows.values(meas), ["node_id", "path"])
    own = session.keep(own.select("node_id", *FIELDS, "t_ns", "seq", "num", "bool", "text").withColumn("id", F.monotonically_increasing_id()), "rows")

    edges = F.inline(F.array(F.struct("t_ns"), F.struct((F.col("t_ns") + F.col("window_ns") + 1).alias("t_ns"))))
    cuts = rules_.ranked(own.select("node_id", "rule", "id", edges).withColumn("seq", F.lit(FIRST_SEQ)), times)
    cuts = session.keep(cuts.select("node_id", "rule", "id", "rank", F.dense_rank().over(Window.partitionBy("rule").orderBy("rank")).alias("slab")), "cuts")
    lives = cuts.groupBy("rule", "id").agg(F.min("slab").alias("since"), F.max("slab").alias("until")).where("since < until")
    slabs = cuts.select("node_id", "rule", "slab", F.col("rank").alias("p1")).distinct()
    slabs = slabs.withColumn("p2", F.lead("p1").over(Window.partitionBy("rule").orderBy("slab"))).where("p2 is not null")
    came = rules_.ranked(own.select("node_id", "rule", "id", F.col("seq").alias("t_ns"), F.lit(FIRST_SEQ).alias("seq")), _swapped(times)).select("rule", "id", F.col("rank").alias("q"))

    cells = own.join(came, ["rule", "id"]).join(lives, ["rule", "id"]).withColumn("slab", F.explode(F.sequence("since", F.col("until") - 1)))
    key, out = ["rule", "slab", "pos"], None
    for agg in [r[0] for r in own.select(F.coalesce("agg", F.lit(LAST))).distinct().collect()]:
        mine = cells.where(F.coalesce("agg", F.lit(LAST)) == agg)
        seen = windows.arrivals(mine, key, [*[c for c in FIELDS if c not in key], "q"], agg)
        seen = seen.withColumn("now", F.coalesce(F.col("some") & rules_._holds(), F.lit(False)).cast("long"))
        delta = F.col("now") - F.coalesce(F.lag("now").over(Window.partitionBy(*key).orderBy("seq")), F.lit(0))
        part = seen.withColumn("delta", delta).where("delta != 0").select("rule", "logic", "size", "slab", "q", "delta")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return session.keep(slabs.select("node_id", "rule", "p1", "p2", F.lit(0).cast("long").alias("q1"), F.lit(0).cast("long").alias("q2")).where("false"), "areas")
    line = Window.partitionBy("rule", "slab").orderBy("q")
    steps = out.groupBy("rule", "logic", "size", "slab", "q").agg(F.sum("delta").alias("delta"))
    steps = steps.withColumn("n", F.sum("delta").over(line)).withColumn("fires", F.when(F.col("logic") == "OR", F.col("n") > 0).otherwise(F.col("n") == F.col("size")))
    steps = steps.withColumn("was", F.lag("fires", 1, False).over(line)).where("fires != was").withColumn("q2", F.lead("q").over(line)).where("fires")
    ends = times.groupBy("node_id").agg(F.count("*").alias("n_all"))
    found = steps.select("rule", "slab", F.col("q").alias("q1"), "q2").join(slabs, ["rule", "slab"]).join(ends, "node_id").withColumn("q2", F.coalesce("q2", "n_all"))
    return session.keep(found.where("q1 < q2 and p1 < p2").select("node_id", "rule", "p1", "p2", "q1", "q2"), "areas")


def counted(areas_: DataFrame, places_: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(rule, sums...): the sums of longs, functions of ``t_ns`` and ``seq``, over the points in the rectangles of each rule."""
    top, last = places_.agg(F.max(F.col("p") + 1), F.max("q")).first()
    bits = int(top or 0).bit_length()
    corner = lambda p, q, d: F.struct(F.col(p).alias("p"), F.col(q).alias("q"), F.lit(d).cast("long").alias("delta"))
    corners = areas_.select("node_id", "rule", F.inline(F.array(corner("p1", "q1", 1), corner("p1", "q2", -1), corner("p2", "q1", -1), corner("p2", "q2", 1))))
    # nothing lies past the ends
    corners = corners.where((F.col("p") < (top or 0)) & (F.col("q") <= (last or 0))).groupBy("node_id", "rule", "p", "q").agg(F.sum("delta").alias("delta")).where("delta != 0")

    def levels(rows: DataFrame, digit: int, *own: Column) -> DataFrame:
        cut = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max(bits, 1) - 1)))).where(F.expr(f"shiftright(p, level) % 2 = {digit}"))
        return cut.select("node_id", "level", F.expr("shiftright(p, level + 1)").alias("parent"), (F.lit(last or 0) - F.col("q")).alias("at"), F.lit(1 - digit).alias("corner"), *own)

    # a corner counts the points from its own rank on, so those past the rank before
    points = levels(places_.withColumn("p", F.col("p") + 1), 1, F.lit(None).cast("long").alias("rule"), F.lit(None).cast("long").alias("delta"), *[x.cast("long").alias(f"_{k}") for k, x in sums.items()])
    both = points.unionByName(levels(corners, 0, "rule", "delta"), allowMissingColumns=True)
    if 1 << bits > windows.HOT:
        # higher levels have large groups, which are cut by arrival
        both = both.withColumn("slab", F.when(F.expr("shiftleft(2L, level)") > windows.HOT, F.expr(f"at div {windows.HOT}L")).otherwise(F.lit(-1).cast("long")))
    for k in sums:
        both = windows.carried(both, ["node_id", "level", "parent"], ["at", "corner"], F.sum, F.col(f"_{k}"), k)
    return both.where("corner = 1").groupBy("rule").agg(*[F.sum(F.col("delta") * F.col(k)).alias(k) for k in sums])


def first_places(areas_: DataFrame, rules: DataFrame, places_: DataFrame, along: str, across: str, size: int = 16) -> DataFrame:
    """(rule, along): the least rank along one axis, ``p`` or ``q``, of the points in each rule's rectangles. Each of ``rules`` has points
    in some; those not found among the first inserts look at 16 times more."""
    left = session.keep(areas_.groupBy("node_id", "rule").agg(F.min(f"{along}1").alias("pos")).join(rules, "rule", "left_semi"), "left")
    out = left.select("rule", F.col("pos").alias(along)).where("false")
    while not left.isEmpty():
        near = areas_.join(left.select("rule", "pos"), "rule").withColumn("first", F.greatest(f"{along}1", "pos")).withColumn("past", F.least(F.col(f"{along}2"), F.col("pos") + size)).where("first < past")
        asked = rules_.ranks_of(near.select("node_id", "rule", f"{across}1", f"{across}2", "first", "past")).withColumnRenamed("rank", along)
        hits = asked.join(places_.select("node_id", along, across), ["node_id", along]).where(f"{across} >= {across}1 and {across} < {across}2")
        found = session.keep(hits.groupBy("rule").agg(F.min(along).alias(along)), "found")
        out = out.unionByName(found)
        left = session.keep(left.join(found, "rule", "left_anti").withColumn("pos", F.col("pos") + size), "left")
        size *= 16
    return out


def totals(meas: DataFrame, series: DataFrame, rules: DataFrame, inserts: DataFrame | None = None, **sums: Column) -> DataFrame:
    """``node_id, rule_id, n_fired, first_ns, first_seq`` of the rules that fire at any insert (see ``rules.replay``), and ``sums`` of
    longs, functions of ``t_ns`` and ``seq``, over these inserts. Firings are laid out only for rules with globs or conditions over all series."""
    conditions = rules_.conditions_of(rules)
    wide = session.keep(conditions.where(F.col("path").contains("*") | F.coalesce("aggregate_series", F.lit(False))).select("node_id", "rule_id").distinct(), "wide")
    own, sums = ["node_id", "rule_id"], {"n_fired": F.lit(1)} | sums
    plain = conditions.join(wide, own, "left_anti")
    numbers = plain.groupBy(*own, "logic").agg(F.count("*").alias("size")).withColumn("rule", F.monotonically_increasing_id())
    numbers = session.keep(numbers, "rules")
    times = session.keep(rules_._evaluations(rules_.insert_times(meas if inserts is None else inserts)), "inserts")
    at = places(times)
    where = areas(meas, series, plain, numbers, times)
    found = session.keep(counted(where, at, sums).where("n_fired > 0"), "counted")
    by_time = first_places(where, found.select("rule"), at, "p", "q").join(numbers.select("rule", "node_id"), "rule").join(at.select("node_id", "p", F.col("t_ns").alias("first_ns")), ["node_id", "p"])
    by_seq = first_places(where, found.select("rule"), at, "q", "p").join(numbers.select("rule", "node_id"), "rule").join(at.select("node_id", "q", F.col("seq").alias("first_seq")), ["node_id", "q"])
    out = found.join(numbers.select(*own, "rule"), "rule").join(by_time.select("rule", "first_ns"), "rule").join(by_seq.select("rule", "first_seq"), "rule")
    out = out.select(*own, "n_fired", "first_ns", "first_seq", *[k for k in sums if k != "n_fired"])
    if wide.isEmpty():
        return out
    fired = rules_.replay(meas, series, rules.join(wide, own, "left_semi"), inserts)
    return out.unionByName(fired.groupBy(*own).agg(F.min("t_ns").alias("first_ns"), F.min("seq").alias("first_seq"), *[F.sum(x.cast("long")).alias(k) for k, x in sums.items()]))
