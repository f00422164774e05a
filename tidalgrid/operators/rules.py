"""Windowed rules: conditions at evaluation times, logic, validation, context of fired rules, commands.

A condition looks at the closed window ``[t - window, t]``; the row of ``t`` itself is visible. Rules are data: they are
exploded to conditions, and the catalog tells which series each condition reads.

Evaluations are times ``(node_id, t_ns)``, at which all rows up to that time count, or inserted rows ``(node_id, t_ns, seq)``: then
only rows that had arrived count (see ``windows``), whatever their order in time.

Where any series suffices, a series' answer can change only when a row enters or leaves the window. So answers are found at
these points, and turned into the places at which a series begins or ceases to hold. The sum of these along a condition's line, cut
into slabs with carries where it is long, tells how many series hold. A place's rank among its node's evaluations makes these
spans of ranks, a rule's spans are summed from its conditions', and evaluations are laid out only where they are asked for. Late
rows change answers at single evaluations; these are asked for one by one. Conditions over all series are answered for each series and evaluation. No window is
folded again for its next answer.

There is one plan for each distinct pair of window and aggregate, and these are few.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidalgrid import schema, session
from tidalgrid.functions import compare, glob, template
from tidalgrid.operators import catalog, windows
from tidalgrid.operators.windows import FIRST_SEQ, LAST, LAST_SEQ


def conditions_of(rules: DataFrame) -> DataFrame:
    """One row for each condition of the active rules: ``node_id, rule_id, logic, pos`` and the condition's fields. The
    aggregate ``last`` is no aggregate; any logic but OR is AND."""
    rows = rules.where("active").select("node_id", "rule_id", F.when(F.upper("logic") == "OR", "OR").otherwise("AND").alias("logic"), F.posexplode("conditions").alias("pos", "c")).select("node_id", "rule_id", "logic", "pos", "c.*")
    return rows.withColumn("agg", F.when(~F.col("agg").isin("", LAST), F.col("agg")))


def glob_keys(globs: DataFrame, spots: DataFrame) -> DataFrame:
    """(node_id, path, pos, segment): of each glob (node_id, path) with literal segments the one that fewest of its node's series have.
    ``spots`` has the series' segments (see ``catalog.segments``). Where a glob has classes or escapes, only a literal head counts."""
    plain = ~F.rlike("path", F.lit(r"[\[\\]"))
    parts = globs.select("node_id", "path", F.posexplode(F.when(plain, F.split("path", "/")).otherwise(F.array(glob.literal_head(F.col("path"))))).alias("pos", "segment"))
    literal = parts.where(F.col("segment").isNotNull() & ~F.rlike("segment", F.lit(r"[*?]")))
    counts = spots.join(literal.select("node_id", "pos", "segment").distinct(), ["node_id", "pos", "segment"], "left_semi").groupBy("node_id", "pos", "segment").agg(F.count("*").alias("n"))
    best = literal.join(counts, ["node_id", "pos", "segment"], "left").groupBy("node_id", "path").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pos", "segment")).alias("b"))
    return best.select("node_id", "path", "b.pos", "b.segment")


def bind(conditions: DataFrame, series: DataFrame) -> DataFrame:
    """The series that each condition reads. Globs meet the catalog only, by the rarest of their literal segments at its place in
    the path, and those without any by their node; exact paths are joined by equality. Any number of globs is one plan."""
    keys = session.keep(series.select("node_id", F.col("path").alias("series_path")).distinct(), "series")
    exact = conditions.where(~F.col("path").contains("*")).join(keys.withColumn("path", F.col("series_path")), ["node_id", "path"])
    starred = conditions.where(F.col("path").contains("*"))
    globs = starred.select("node_id", "path").distinct()
    spots = catalog.segments(keys, "series_path")
    chosen = glob_keys(globs, spots)
    fixed = chosen.join(spots, ["node_id", "pos", "segment"]).select("node_id", "path", "series_path")
    free = globs.join(chosen, ["node_id", "path"], "left_anti").join(keys, "node_id").select("node_id", "path", "series_path")
    met = fixed.unionByName(free).where(F.rlike("series_path", glob.regex_of(F.col("path"))))
    return exact.select(*conditions.columns, "series_path").unionByName(starred.join(met, ["node_id", "path"]).select(*conditions.columns, "series_path"))


IDS = ["node_id", "rule_id", "logic", "pos", "op", "t_double", "t_long", "t_bool", "t_text", "agg", "aggregate_series"]


def _evaluations(times: DataFrame) -> DataFrame:
    """(node_id, t_ns, seq); without ``seq`` all rows of a time have arrived."""
    return (times if "seq" in times.columns else times.withColumn("seq", F.lit(LAST_SEQ))).select("node_id", "t_ns", "seq").distinct()


def _asked(times: DataFrame) -> DataFrame:
    """The evaluations, written once for all that reads them."""
    return session.keep(_evaluations(times), "evaluations")


def _marked(meas: DataFrame, arrival: bool) -> DataFrame:
    """Values, with ``late`` where evaluations are inserted rows (``arrival``)."""
    if not arrival:
        return windows.values(meas)
    return session.keep(windows.values(windows.mark_late(meas)), "arrivals")


def _kinds(bound: DataFrame) -> list[tuple[int, str, DataFrame]]:
    """(window, aggregate, conditions with ``pattern`` and the series' ``path``) for each distinct pair."""
    found = [tuple(r) for r in bound.select("window_ns", F.coalesce("agg", F.lit(LAST)).alias("agg")).distinct().collect()]
    own = bound.withColumnRenamed("path", "pattern").withColumnRenamed("series_path", "path")
    return [(w, a, own.where((F.col("window_ns") == w) & (F.coalesce("agg", F.lit(LAST)) == a))) for w, a in found if w is not None and w >= 0]


def evaluate_conditions(rows: DataFrame, bound: DataFrame, times: DataFrame) -> DataFrame:
    """For each bound condition, series and evaluation with data in the window: ``t_ns, seq, num, bool, text``. Where ``times`` has
    ``rule_id``, a rule's series are looked at only at its own evaluations."""
    out = None
    on = [c for c in ("node_id", "rule_id") if c in times.columns]
    for window_ns, agg, mine in _kinds(bound):
        keys = mine.select("node_id", "path").distinct()
        asks = mine.select(*on, "path").distinct().join(times, on).select("node_id", "path", "t_ns", "seq").distinct()
        found = windows.look(rows.join(keys, ["node_id", "path"], "left_semi"), asks, window_ns, agg)
        part = mine.join(found.where("some").drop("some"), ["node_id", "path"])
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = bound.withColumnRenamed("path", "pattern").withColumnRenamed("series_path", "path").where("false")
        out = out.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("t_ns", "long"), ("seq", "long"), ("num", "double"), ("bool", "boolean"), ("text", "string"))])
    return out


PLACE = ["node_id", "rule_id", "logic", "pos", "t_ns", "seq"]


def turns(rows: DataFrame, bound: DataFrame) -> DataFrame:
    """(node_id, rule_id, logic, pos, t_ns, seq, delta): where a series begins (1) or ceases (-1) to fulfil a condition; late rows
    aren't looked at."""
    out = None
    if "late" in rows.columns:
        rows = rows.where("not late").drop("late")
        entry, leave = F.col("seq"), F.lit(FIRST_SEQ)
    else:
        entry = leave = F.lit(LAST_SEQ)
    for window_ns, agg, mine in _kinds(bound):
        own = rows.join(mine.select("node_id", "path").distinct(), ["node_id", "path"], "left_semi")
        # a row counts from its own place on and leaves one nanosecond after the window
        points = F.array(F.struct(F.col("t_ns"), entry.alias("seq")), F.struct((F.col("t_ns") + F.lit(window_ns + 1)).alias("t_ns"), leave.alias("seq")))
        asks = own.select("node_id", "path", F.inline(points)).distinct()
        held = mine.join(windows.look(own, asks, window_ns, agg), ["node_id", "path"]).withColumn("now", (F.col("some") & _holds()).cast("int"))
        order = Window.partitionBy("node_id", "rule_id", "logic", "pos", "path").orderBy("t_ns", "seq")
        part = held.withColumn("delta", F.col("now") - F.coalesce(F.lag("now").over(order), F.lit(0))).where("delta != 0").select(*PLACE, "delta")
        out = part if out is None else out.unionByName(part)
    return bound.select(*PLACE[:4], F.lit(0).cast("long").alias("t_ns"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("delta")).where("false") if out is None else out


def late_changes(rows: DataFrame, bound: DataFrame, times: DataFrame) -> DataFrame:
    """(node_id, rule_id, logic, pos, t_ns, seq, n): at which evaluations late rows make a series fulfil a condition (1), or no
    longer (-1)."""
    out = None
    for window_ns, agg, mine in _kinds(bound):
        own = rows.join(mine.select("node_id", "path").distinct(), ["node_id", "path"], "left_semi")
        asks = windows.late_asks(own.where("late"), times, window_ns)
        states = [windows.look(x, asks, window_ns, agg) for x in (own, own.where("not late").drop("late"))]
        both = [mine.join(x, ["node_id", "path"]).select(*PLACE, "path", F.coalesce(F.col("some") & _holds(), F.lit(False)).cast("int").alias(name)) for x, name in zip(states, ("with", "without"), strict=True)]
        part = both[0].join(both[1], [*PLACE, "path"]).where("with != without").select(*PLACE, (F.col("with") - F.col("without")).cast("long").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def ranked(line: DataFrame, times: DataFrame) -> DataFrame:
    """``line`` (node_id, t_ns, seq, ...) with ``rank``, the number of the node's evaluations before each place."""
    asked = times.select("node_id", "t_ns", "seq", F.lit(1).cast("long").alias("asked"))
    both = windows.dealt(line.withColumn("asked", F.lit(0).cast("long")).unionByName(asked, allowMissingColumns=True), ["node_id"], "t_ns")
    found = windows.carried(both, ["node_id"], ["t_ns", "seq", "asked"], F.sum, F.col("asked"), "rank")
    return found.where("asked = 0").select(*line.columns, "rank")


def numbered_times(times: DataFrame) -> DataFrame:
    """(node_id, t_ns, seq, rank): the evaluations of each node in order, from 0."""
    return windows.numbered(windows.dealt(times, ["node_id"], "t_ns"), ["node_id"], "rank", ["t_ns", "seq"]).select("node_id", "t_ns", "seq", "rank")


def steps(line: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, n, first, past): the spans of ranks along ``line`` (keys, rank, delta) at which the sum of deltas, ``n``, is positive."""
    own = windows.carried(windows.dealt(line, keys, order[0]), keys, order, F.sum, F.col("delta"), "n")
    own = windows.lagged(own, keys, "rank", "first", "_none", order)
    return own.where("n > 0 and rank > first").select(*keys, "n", "first", F.col("rank").alias("past"))


def condition_spans(rows: DataFrame, bound: DataFrame, times: DataFrame) -> DataFrame:
    """(node_id, rule_id, logic, pos, n, first, past): between which ranks of its node's evaluations ``n`` series fulfil a
    condition. Spans grow with the rows, whatever the number of evaluations."""
    ids = PLACE[:4]
    line = turns(rows, bound).groupBy(*PLACE).agg(F.sum("delta").cast("long").alias("delta")).where("delta != 0")
    # written before it is ranked, as that counts its rows first
    line = session.keep(ranked(session.keep(line, "turns"), times), "ranked")
    # each line ends after its node's last evaluation
    ends = times.groupBy("node_id").agg(F.max("t_ns").alias("t_ns"), F.count("*").alias("rank")).withColumn("seq", F.lit(LAST_SEQ)).withColumn("delta", F.lit(0).cast("long"))
    closed = line.unionByName(line.select(*ids).distinct().join(F.broadcast(ends), "node_id").select(*line.columns))
    return session.keep(steps(closed, ids, ["t_ns", "seq", "rank"]), "spans")


def fired_spans(spans: DataFrame, conditions: DataFrame) -> DataFrame:
    """(node_id, rule_id, first, past): between which ranks a rule fires; ``spans`` are those of its conditions."""
    rule = ["node_id", "rule_id", "logic"]
    edges = F.array(F.struct(F.col("first").alias("rank"), F.lit(1).cast("long").alias("delta")), F.struct(F.col("past").alias("rank"), F.lit(-1).cast("long").alias("delta")))
    line = spans.select(*rule, F.inline(edges)).groupBy(*rule, "rank").agg(F.sum("delta").alias("delta"))
    sizes = conditions.groupBy(*rule).agg(F.count("*").alias("size"))
    return steps(line, rule, ["rank"]).join(sizes, rule).where("logic = 'OR' or n = size").select("node_id", "rule_id", "first", "past")


#: Evaluations of a span that one row holds at most while it is laid out.
CHUNK = 4096


def ranks_of(spans: DataFrame) -> DataFrame:
    """``spans`` with a row for each ``rank`` in place of first and past."""
    keep = [c for c in spans.columns if c not in ("first", "past")]
    cut = spans.select("*", F.explode(F.sequence(F.expr(f"first div {CHUNK}L"), F.expr(f"(past - 1) div {CHUNK}L"))).alias("_c"))
    ranks = F.sequence(F.greatest("first", F.col("_c") * CHUNK), F.least(F.col("past"), (F.col("_c") + 1) * CHUNK) - 1)
    return cut.select(*keep, F.explode(ranks).alias("rank"))


def laid_out(spans: DataFrame, times: DataFrame) -> DataFrame:
    """``spans`` with the evaluations in place of the ranks: a row for each."""
    return ranks_of(spans).join(numbered_times(times), ["node_id", "rank"]).drop("rank")


def any_truth(rows: DataFrame, bound: DataFrame, times: DataFrame) -> DataFrame:
    """(node_id, rule_id, logic, pos, t_ns, seq, holds): the evaluations at which any series fulfils a condition."""
    found = laid_out(condition_spans(rows, bound, times), times).select(*PLACE, "n")
    if "late" in rows.columns and not rows.where("late").isEmpty():
        changes = late_changes(rows, bound, times)
        if changes is not None:
            found = found.unionByName(changes).groupBy(*PLACE).agg(F.sum("n").alias("n")).where("n > 0")
    return found.select(*PLACE, F.lit(True).alias("holds"))


def _holds() -> Column:
    value = {"number": F.col("num"), "bool": F.col("bool"), "text": F.col("text")}
    limit = {"number": F.coalesce("t_double", F.col("t_long").cast("double")), "bool": F.col("t_bool"), "text": F.col("t_text")}
    return compare.compare(value, F.col("op"), limit)


def condition_truth(results: DataFrame) -> DataFrame:
    """Folds the series of conditions with ``aggregate_series``: the first one by path (last values) or the aggregate of the
    series' aggregates is compared."""
    ids = [*IDS, "t_ns", "seq"]
    first = results.where("agg is null").groupBy(*ids).agg(F.min_by(F.struct("num", "bool", "text"), "path").alias("v")).select(*ids, "v.*")
    folded = {"avg": F.avg("num"), "max": F.max("num"), "min": F.min("num"), "sum": F.sum("num"), "count": F.count("num").cast("double")}
    value = F.lit(None).cast("double")
    group = results.where("agg is not null").groupBy(*ids).agg(*[x.alias(f"_{k}") for k, x in folded.items()])
    for k in folded:
        value = F.when(F.col("agg") == k, F.col(f"_{k}")).otherwise(value)
    group = group.select(*ids, value.alias("num"), F.lit(None).cast("boolean").alias("bool"), F.lit(None).cast("string").alias("text"))
    return first.unionByName(group).select(*PLACE, _holds().alias("holds")).where("holds")


def _known(series: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conditions, conditions with the series they read), written once for all that reads them."""
    conditions = session.keep(conditions_of(rules), "conditions")
    return conditions, session.keep(bind(conditions, series), "bound")


def _held(meas: DataFrame, conditions: DataFrame, bound: DataFrame, asked: DataFrame, arrival: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """Where rules fire at the evaluations ``asked``: as spans of ranks (see ``fired_spans``), or, where conditions look over all series
    or rows are late, as evaluations (node_id, rule_id, t_ns, seq). ``arrival`` tells whether evaluations are inserted rows."""
    whole = F.coalesce("aggregate_series", F.lit(False))
    rows = _marked(meas, arrival)
    some = not bound.where(whole).isEmpty()
    if not some and ("late" not in rows.columns or rows.where("late").isEmpty()):
        return fired_spans(condition_spans(rows, bound, asked), conditions), None
    truth = any_truth(rows, bound.where(~whole), asked)
    if some:
        truth = truth.unionByName(condition_truth(evaluate_conditions(rows, bound.where(whole), asked)))
    sizes = conditions.groupBy("node_id", "rule_id", "logic").agg(F.count("*").alias("n"))
    held = truth.groupBy("node_id", "rule_id", "t_ns", "seq").agg(F.sum(F.col("holds").cast("int")).alias("held"))
    return None, held.join(sizes, ["node_id", "rule_id"]).where("if(logic = 'OR', held > 0, held = n)").select("node_id", "rule_id", "t_ns", "seq")


def _firings(meas: DataFrame, conditions: DataFrame, bound: DataFrame, asked: DataFrame, arrival: bool) -> DataFrame:
    """(node_id, rule_id, t_ns, seq, fired): the evaluations at which a rule fires."""
    spans, held = _held(meas, conditions, bound, asked, arrival)
    found = held if spans is None else laid_out(spans, asked)
    return found.select("node_id", "rule_id", "t_ns", "seq", F.lit(True).alias("fired"))


def evaluate_rules(meas: DataFrame, series: DataFrame, rules: DataFrame, times: DataFrame) -> DataFrame:
    """``node_id, rule_id, t_ns, fired`` (and ``seq`` if ``times`` has it) for each active rule with conditions and each evaluation of
    its node.

    Conditions without data or without any series are false; rules without conditions don't appear.
    """
    (conditions, bound), asked = _known(series, rules), _asked(times)
    held = _firings(meas, conditions, bound, asked, "seq" in times.columns)
    grid = conditions.select("node_id", "rule_id").distinct().join(asked, "node_id").join(held, ["node_id", "rule_id", "t_ns", "seq"], "left")
    return grid.select("node_id", "rule_id", "t_ns", *[c for c in ("seq",) if c in times.columns], F.coalesce("fired", F.lit(False)).alias("fired"))


def insert_times(meas: DataFrame) -> DataFrame:
    """Every insert evaluates all rules of its node at the inserted row's time, over what has arrived."""
    return meas.select("node_id", F.col("ts_ns").alias("t_ns"), "seq")


def replay(meas: DataFrame, series: DataFrame, rules: DataFrame, inserts: DataFrame | None = None) -> DataFrame:
    """``node_id, rule_id, t_ns, seq, fired`` of the inserts at which a rule fires; no row is made for a rule that doesn't hold.
    ``inserts`` are the evaluated ones, if not all of ``meas``."""
    return _firings(meas, *_known(series, rules), _asked(insert_times(meas if inserts is None else inserts)), True)


def totals(meas: DataFrame, series: DataFrame, rules: DataFrame, times: DataFrame) -> DataFrame:
    """``node_id, rule_id, n_fired, first_ns`` of the rules that fire at any of ``times`` (node_id, t_ns[, seq]), counted from spans:
    firings aren't laid out unless conditions look over all series or rows are late."""
    rule, asked = ["node_id", "rule_id"], _asked(times)
    spans, held = _held(meas, *_known(series, rules), asked, "seq" in times.columns)
    if spans is None:
        return held.groupBy(*rule).agg(F.count("*").alias("n_fired"), F.min("t_ns").alias("first_ns"))
    found = spans.groupBy(*rule).agg(F.sum(F.col("past") - F.col("first")).alias("n_fired"), F.min("first").alias("rank"))
    return found.join(numbered_times(asked), ["node_id", "rank"]).select(*rule, "n_fired", F.col("t_ns").alias("first_ns"))


def validate(rules: DataFrame, series: DataFrame) -> DataFrame:
    """``node_id, rule_id, reasons, valid``: reasons are sorted names of what is wrong with the rule. An unknown logic is none,
    as it counts as AND."""
    kinds = series.select("node_id", F.col("path").alias("series_path"), "value_type").distinct()
    con = rules.select("node_id", "rule_id", F.posexplode("conditions").alias("pos", "c")).select("node_id", "rule_id", "pos", "c.*")
    con = con.withColumn("agg", F.when(~F.col("agg").isin("", LAST), F.col("agg")))
    numeric = con.where("agg is not null")
    types = bind(numeric.withColumn("logic", F.lit("AND")), series).join(kinds, ["node_id", "series_path"]).groupBy("node_id", "rule_id", "pos").agg(
        F.count_distinct("value_type").alias("n_types"), F.max(F.col("value_type").isin("Real", "Integer").cast("int")).alias("numeric")
    )
    set_ = [F.col(c).isNotNull().cast("int") for c in ("t_double", "t_long", "t_bool", "t_text")]
    worded = F.col("t_bool").isNotNull() | F.col("t_text").isNotNull()
    checks = {
        "aggregate": F.col("agg").isNotNull() & ~F.col("agg").isin(*schema.AGGREGATES),
        "aggregate_type": F.col("agg").isin("avg", "max", "min", "sum") & ((F.col("numeric") == 0) | (F.col("n_types") > 1)),
        "operator": ~F.coalesce(F.col("op").isin(*schema.OPERATORS), F.lit(False)),
        "operator_type": worded & ~F.coalesce(F.col("op").isin("==", "!="), F.lit(False)),
        "path": F.coalesce(F.col("path"), F.lit("")) == "",
        "threshold": (set_[0] + set_[1] + set_[2] + set_[3]) != 1,
        "window": ~F.coalesce(F.col("window_ns") > 0, F.lit(False)),
    }
    wrong = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]))
    per = con.join(types, ["node_id", "rule_id", "pos"], "left").groupBy("node_id", "rule_id").agg(F.flatten(F.collect_list(wrong)).alias("bad"))
    own = {
        "action_kind": F.exists("actions", lambda a: F.coalesce(a["kind"], F.lit("")) == ""),
        "actions": F.coalesce(F.size("actions"), F.lit(0)) < 1,
        "conditions": F.coalesce(F.size("conditions"), F.lit(0)) < 1,
        "id": F.coalesce(F.col("rule_id"), F.lit("")) == "",
        "target": F.exists("actions", lambda a: F.coalesce(a["target"], F.lit("")) == ""),
        "template": F.exists("actions", lambda a: ~F.coalesce(template.valid(a["target"]), F.lit(True))),
        "variables": F.exists("actions", lambda a: F.coalesce(template.valid(a["target"]) & (F.size(template.missing(a["target"], F.coalesce(a["params"], F.create_map().cast("map<string,string>")))) > 0), F.lit(False))),
    }
    mine = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in own.items()]))
    both = rules.select("node_id", "rule_id", mine.alias("own")).join(per, ["node_id", "rule_id"], "left")
    return both.select("node_id", "rule_id", F.array_sort(F.array_distinct(F.concat("own", F.coalesce("bad", F.array().cast("array<string>"))))).alias("reasons")).withColumn("valid", F.size("reasons") == 0)


def state(rules: DataFrame, enabled: bool = True) -> DataFrame:
    return rules.agg(F.lit(enabled).alias("enabled"), F.count_if("active").alias("n_active"), F.count("*").alias("n_rules"))


def context(fired: DataFrame, meas: DataFrame, series: DataFrame, rules: DataFrame) -> DataFrame:
    """For each fired rule and evaluation: ``serie``, the first series of its first condition with data, and ``context``, a map of
    each series to its last value in the window."""
    return _context(fired, meas, _known(series, rules)[1])


def contexts(meas: DataFrame, series: DataFrame, rules: DataFrame, times: DataFrame) -> DataFrame:
    """The ``context`` of each firing at ``times``: conditions meet their series once for both, and there is no row for a rule that
    doesn't fire."""
    conditions, bound = _known(series, rules)
    fired = _firings(meas, conditions, bound, _asked(times), "seq" in times.columns)
    return _context(fired if "seq" in times.columns else fired.drop("seq"), meas, bound)


def _context(fired: DataFrame, meas: DataFrame, bound: DataFrame) -> DataFrame:
    bound = bound.withColumn("agg", F.lit(None).cast("string"))
    place = [c for c in ("node_id", "rule_id", "t_ns", "seq") if c in fired.columns]
    fired = session.keep(fired.where("fired"), "fired").select(*place)
    asked = fired if "seq" in place else fired.withColumn("seq", F.lit(LAST_SEQ))
    hits = evaluate_conditions(_marked(meas, "seq" in place), bound, asked).join(fired, place, "left_semi")
    one = hits.groupBy(*place, "path").agg(F.min("pos").alias("pos"), F.min_by(F.struct("num", "bool", "text"), "pos").alias("v")).select(*place, "path", "pos", "v.*")
    entries = F.array_sort(F.collect_list(F.struct("path", "num", "bool", "text")))
    found = one.groupBy(*place).agg(F.min_by("path", F.struct("pos", "path")).alias("serie"), entries.alias("e"))
    value = lambda e: F.coalesce(e["num"].cast("variant"), e["bool"].cast("variant"), e["text"].cast("variant"))
    return found.select(*place, "serie", F.map_from_entries(F.transform("e", lambda e: F.struct(e["path"], value(e)))).alias("context"))


def build_commands(contexts: DataFrame, rules: DataFrame) -> DataFrame:
    """``topic`` and JSON ``value`` of each action of each fired rule (at its ``seq``, where arrival counts). ``comando`` leaves the parameters, and names that start
    with ``_`` leave the context, whose values keep their types.

    An action whose topic comes out empty fails: it has an ``error`` and no value, and its rule's later actions don't run.
    """
    place = [c for c in ("node_id", "rule_id", "t_ns", "seq") if c in contexts.columns]
    acts = rules.select("node_id", "rule_id", "name", F.posexplode("actions").alias("step", "a")).select("node_id", "rule_id", "name", "step", "a.*")
    rows = contexts.join(acts, ["node_id", "rule_id"])
    topic = template.resolve(F.col("target"), F.col("params"), F.col("rule_id"), F.col("name"), F.col("serie"))
    rows = rows.withColumn("topic", topic).withColumn("error", F.when(F.coalesce("topic", F.lit("")) == "", "empty topic"))
    stop = F.min(F.when(F.col("error").isNotNull(), F.col("step"))).over(Window.partitionBy(*place))
    rows = rows.withColumn("stop", stop).where("stop is null or step <= stop")
    body = F.to_json(
        F.struct(
            F.col("params")["comando"].alias("comando"),
            F.col("t_ns").alias("timestamp"),
            F.col("rule_id").alias("regla_id"),
            F.map_filter("params", lambda k, _: k != "comando").alias("parametros"),
            F.map_filter("context", lambda k, _: ~k.startswith("_")).alias("contexto"),
        )
    )
    return rows.select(*place, "step", "kind", "topic", F.when(F.col("error").isNull(), body).alias("value"), "error")


def to_files(commands: DataFrame, path: str, mode: str = "append") -> None:
    """Commands without errors as JSON lines, one folder for each kind."""
    commands.where("error is null").select("kind", "node_id", "rule_id", "t_ns", "step", "topic", "value").write.mode(mode).partitionBy("kind").json(path)


def to_kafka(commands: DataFrame, servers: str, topic: str | None = None, format_: str = "kafka", **options: str) -> None:
    """Commands without errors as records: to one ``topic`` with the command's topic as key, or each to its own, with dots for
    slashes. The Kafka package must be on the cluster."""
    own = F.lit(topic) if topic else F.replace("topic", F.lit("/"), F.lit("."))
    records = commands.where("error is null").select(F.col("topic").alias("key"), "value", own.alias("topic"))
    records.write.format(format_).option("kafka.bootstrap.servers", servers).options(**options).save()


def _log(commands: DataFrame) -> None:
    for r in commands.toLocalIterator():
        logging.getLogger(__name__).info("%s %s %s", r["rule_id"], r["topic"], r["value"])


class Handlers:
    """Callbacks by action kind for ``foreachBatch``. Each gets the commands of its kind, step by step; unknown kinds are passed
    over. A handler may return the firings (``node_id, rule_id, t_ns``) that failed, or raise, which fails all it was given:
    later actions of these firings don't run."""

    def __init__(self):
        self.by_kind: dict[str, Callable[[DataFrame], DataFrame | None]] = {"log": _log}

    def register(self, kind: str, handler: Callable[[DataFrame], DataFrame | None]) -> None:
        if not kind:
            raise ValueError("an action kind is needed")
        self.by_kind[kind] = handler

    def run(self, commands: DataFrame) -> None:
        """``commands`` are computed once, and are kept for all steps."""
        firing = [c for c in ("node_id", "rule_id", "t_ns", "seq") if c in commands.columns]
        commands = commands.where("error is null").persist()
        try:
            for step, kind in sorted((r["step"], r["kind"]) for r in commands.select("step", "kind").distinct().collect()):
                if kind not in self.by_kind:
                    continue
                mine = commands.where((F.col("step") == step) & (F.col("kind") == kind))
                try:
                    failed = self.by_kind[kind](mine)
                except Exception:
                    logging.getLogger(__name__).exception("action %s failed", kind)
                    failed = mine
                if failed is not None:
                    before, commands = commands, commands.join(failed.select(*firing).distinct(), firing, "left_anti").persist()
                    commands.count()
                    before.unpersist()
        finally:
            commands.unpersist()
