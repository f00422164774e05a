"""Ranges, tiers, aggregates, buckets, blocks, encodings and rules on small tables."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from helpers import measure
from pyspark.sql import functions as F

from tidalgrid import render, schema
from tidalgrid.functions import glob
from tidalgrid.operators import aggregate, bridge, catalog, encoding, lifecycle, query
from tidalgrid.operators import rules as rules_
from tidalgrid.operators import windows
from tidalgrid.plans import views
from tidalgrid.sources import registry, storage
from tidalgrid.streaming import streams

H = 3_600_000_000_000


def points(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_range_and_average(spark):
    m = measure(spark, [("sensor/temp", 1000, 20), ("sensor/temp", 2000, 21), ("sensor/temp", 3000, 22), ("other/temp", 1, 1)])
    assert query.range_query(m, views.keys(m), "sensor/temp", 1000, 3000).count() == 3
    assert points(aggregate.aggregate(m, views.keys(m), "sensor/*", 0, 5000, ["avg", "count"]), "path", "avg", "count") == [("sensor/temp", 21.0, 3.0)]
    with pytest.raises(ValueError):
        aggregate.exprs([])
    with pytest.raises(ValueError):
        aggregate.n_buckets(0, 10, 0)


def test_glob_aggregate(spark):
    m = measure(spark, [("sensor_01/temp", 1, 10), ("sensor_01/temp", 2, 20), ("sensor_02/temp", 1, 30), ("sensor_02/temp", 2, 40)])
    assert points(aggregate.aggregate(m, views.keys(m), "*/temp", 0, 9, ["avg"]), "path", "avg") == [("sensor_01/temp", 15.0), ("sensor_02/temp", 35.0)]


def test_hourly_buckets(spark):
    m = measure(spark, [("s/t", 1000, 10), ("s/t", 2000, 20), ("s/t", H + 1000, 30), ("s/t", H + 2000, 40)])
    got = aggregate.bucket_aggregate(m, views.keys(m), "s/t", 0, 2 * H, ["avg"], H)
    assert points(got, "bucket", "start_ns", "avg") == [(0, 0, 15.0), (1, H, 35.0)]


def test_bucket_edges(spark):
    m = measure(spark, [("s", 100, 10), ("s", 500, 20), ("s", 1100, 30), ("s", 1500, 40), ("s", 2100, 50), ("s", 2500, 60), ("s", 3000, 70)])
    keys = views.keys(m)
    assert points(aggregate.bucket_aggregate(m, keys, "s", 0, 3000, ["avg"], 1000), "bucket", "avg") == [(0, 15.0), (1, 35.0), (2, 60.0)]
    assert points(aggregate.bucket_aggregate(m, keys, "s", 0, 5000, ["count"], 24 * H), "bucket", "count") == [(0, 7.0)]
    assert aggregate.bucket_aggregate(m, keys, "s", 100, 100, ["avg"], 10).count() == 0
    assert points(aggregate.bucket_aggregate(m, keys, "s", 0, 5000, ["avg"], 1000), "bucket", "avg")[4] == (4, None)
    assert aggregate.bucket_grid(spark, 0, 2500, 1000).count() == 3


def test_tiers(spark):
    cold, hot = measure(spark, [("s", 1000, 10), ("s", 2000, 20)]), measure(spark, [("s", 2000, 25), ("s", 3000, 30)])
    assert points(query.merge_tiers(hot, cold), "ts_ns", "v_double") == [(1000, 10.0), (2000, 25.0), (3000, 30.0)]
    empty = measure(spark, [("s", 2000, None)])
    assert points(query.merge_tiers(empty, cold), "ts_ns", "v_double") == [(1000, 10.0), (2000, 20.0)]
    merged = query.merge_tiers(hot, cold)
    assert points(query.merge_tiers(merged, merged), "ts_ns", "v_double") == points(merged, "ts_ns", "v_double")
    assert points(query.last_point_global(hot, cold, views.keys(cold), "s"), "ts_ns", "v_double") == [(3000, 30.0)]


def test_alignment(spark):
    m = measure(spark, [("temp", 1000, 1), ("temp", 2000, 2), ("humidity", 2000, 3), ("humidity", 3000, 4)])
    rows = render.wide(m, "v_double").collect()
    assert [tuple(r) for r in rows] == [(1000, None, 1.0), (2000, 3.0, 2.0), (3000, 4.0, None)]


def test_last_point_ties(spark):
    m = measure(spark, [("s", 5, 1), ("s", 9, 2), ("s", 9, 3), ("s", 7, 4)])
    assert points(query.last_point(m, views.keys(m), "s"), "ts_ns", "v_double") == [(9, 2.0)]
    assert points(query.last_point(m, views.keys(m), "s", None, 8), "ts_ns", "v_double") == [(7, 4.0)]
    assert query.last_point(m, views.keys(m), "none").count() == 0


def test_unavailable(spark):
    m = measure(spark, [("s", 1, 1)])
    down = spark.createDataFrame([("n", False)], "node_id string, reachable boolean")
    assert query.unavailable_nodes(views.keys(m), down, "s").first()[0] == ["n"]
    assert query.unavailable_nodes(views.keys(m), down, "t").first()[0] == []


def test_ingest(spark):
    m = measure(spark, [("s", 1, 1), ("t", 1, 1), ("s", 2, None)])
    series = spark.createDataFrame([("n", "s", "Real")], "node_id string, path string, value_type string")
    valid, rejects = storage.ingest(m, series)
    assert points(valid, "path", "ts_ns") == [("s", 1)]
    assert points(rejects, "path", "reason") == [("s", "wrong type"), ("t", "unknown path")]


def test_keys(spark):
    keys = spark.createDataFrame([("n/0000000001_00000000000000000005_00000000000000000009",), ("n/x_1_2",), ("",), ("n/1_2",)], "object_key string")
    assert points(storage.parse_keys(keys), "node_id", "series_id", "t_start", "t_end") == [("n", 1, 5, 9)]
    back = storage.format_key(storage.parse_keys(keys).drop("object_key")).first()
    assert (back.object_key, back.prefix) == ("n/0000000001_00000000000000000005_00000000000000000009", "n/0000000001_")


def test_storage_round_trip(spark, tmp_path):
    m = measure(spark, [("s", 5, 1), ("s", storage.DAY_NS + 7, 2)])
    for codec in schema.BLOCK_CODECS:
        storage.write_measurements(m, f"{tmp_path}/{codec}", codec)
        assert points(storage.read_measurements(spark, f"{tmp_path}/{codec}", storage.DAY_NS, None), "ts_ns", "v_double") == [(storage.DAY_NS + 7, 2.0)]


def test_retention(spark):
    m = measure(spark, [("s", 0, 1), ("s", 1, 2)])
    series = spark.createDataFrame([("n", "s", 1 * H, 10)], "node_id string, path string, retention_ns long, block_size int")
    hot, cold = lifecycle.tier(m, series, 2 * H)
    assert (hot.count(), cold.count()) == (0, 2)
    forever = series.withColumn("retention_ns", F.lit(0).cast("long"))
    assert lifecycle.tier(m, forever, 2 * H)[0].count() == 2
    late = measure(spark, [("s", 0, 1), ("s", 2 * H, 2)])
    assert lifecycle.tier(late, series, 2 * H)[0].count() == 2
    assert lifecycle.tier(late, series, 2 * H, by_block=False)[0].count() == 1
    assert lifecycle.delete_series(m, views.keys(m)).count() == 0


def test_encodings(spark):
    rnd = random.Random(1)
    for data in ([*range(8)], [0, 128, 255], [100] * 4, [-10, -5, 0, 5, 10], [42] * 600, [1000 + 10 * i for i in range(50)], [rnd.randint(-(10**12), 10**12) for _ in range(40)]):
        rows = spark.createDataFrame([("n", "s", i, x) for i, x in enumerate(data)], "node_id string, path string, seq long, value long")
        assert [r.value for r in encoding.expand(encoding.runs(rows)).orderBy("pos").collect()] == data
        assert [r.value for r in encoding.undo_delta_of_delta(encoding.delta_of_delta(rows, "value")).orderBy("pos").collect()] == data
    long = spark.createDataFrame([("n", "s", i, 42) for i in range(600)], "node_id string, path string, seq long, value long")
    assert [r.n for r in encoding.runs(long).orderBy("run").collect()] == [255, 255, 90]
    assert encoding.advice(long).first().codec == "Bits"
    assert encoding.bit_width(long).first().bits == 0
    real = spark.createDataFrame([("n", "s", i, x) for i, x in enumerate([20.0, 20.0, 1.0, -1.0])], "node_id string, path string, seq long, value double")
    assert points(encoding.xor_profile(real), "seq", "leading", "meaningful")[0] == (1, 64, 0)
    assert points(encoding.xor_profile(real), "seq", "leading", "meaningful")[2] == (3, 0, 1)


def test_block_advice(spark):
    columns = "node_id string, path string, seq long, value_type string, v_double double, v_long long, v_bool boolean, v_text string"
    rows = [("n", "a", i, "Integer", None, 42, None, None) for i in range(600)]
    rows += [("n", "b", i, "Text", None, None, None, ("long text one", "long text two")[i // 5 % 2]) for i in range(100)]
    rows += [("n", "c", i, "Real", 25.0 + i % 2, None, None, None) for i in range(50)]
    rows += [("n", "d", i, "Boolean", None, None, i < 30, None) for i in range(60)]
    rows += [("n", "e", i, "Real", x, None, None, None) for i, x in enumerate([1e300, -1e300, None, float("nan")])]
    found = encoding.block_advice(spark.createDataFrame(rows, columns))
    # constant bits; 20 runs of ids after 32 bytes of entries; 96 bits and 49 times 13 + 1; two runs of 2 bytes
    expected = [("a", "Bits", 17), ("b", "Dictionary", 2 + 30 + 60), ("d", "RLE", 4)]
    assert [x for x in points(found, "path", "codec", "bytes") if x[0] in "abd"] == expected
    reals = {p: (c, b) for p, c, b in points(found, "path", "codec", "bytes")}
    assert reals["c"][0] == "Xor" and reals["c"][1] < 50 * 8 and reals["e"] == ("None", 24)
    assert len(points(encoding.block_advice(spark.createDataFrame(rows, columns), 100), "path", "block")) == 6 + 4
    assert encoding.block_advice(spark.createDataFrame([], columns)).count() == 0


def test_bridge(spark):
    rows = spark.createDataFrame([("t", "héllo", "mqtt", 1)], "topic string, payload string, origin string, id int")
    sent = bridge.encode(rows).select("id", "origin", "value")
    more = sent.union(spark.createDataFrame([(2, "http", "oops"), (3, "http", None), (4, "http", '{"topico":""}')], "id int, origin string, value string"))
    decoded = bridge.decode(more)
    assert points(decoded, "id", "topic", "payload") == [(1, "t", "héllo")]
    out = bridge.fan_out(decoded)
    assert points(out, "dest", "original") == [("coap", False), ("http", False)]
    assert bridge.fan_out(out).count() == 0
    assert bridge.deliver(out, spark.createDataFrame([("u", "x")], "topic string, subscriber string")).count() == 0


def rule(path="*/t", window=100, agg=None, op=">", limit=5.0, whole=False, **more):
    condition = {"path": path, "window_ns": window, "agg": agg, "op": op, "t_double": limit, "t_long": None, "t_bool": None, "t_text": None, "aggregate_series": whole}
    action = {"kind": "publish", "target": "act/{serie_0}", "params": {"comando": "encender", "velocidad": "alta", "_x": "1"}}
    return {"node_id": "n", "rule_id": "r", "name": "rule", "active": True, "logic": "AND", "conditions": [condition], "actions": [action]} | more


def test_rules_read_measurements_few_times(spark):
    """Series, bound conditions and turns are written once, not worked out again for each step that reads or counts them; firings
    and their contexts bind once."""
    reads, plain = spark.sparkContext.accumulator(0), measure(spark, [(f"{x}/{k}", 10 * i, i % 7) for i, x in enumerate("abcdefgh") for k in "tu"])
    m = spark.createDataFrame(plain.rdd.map(lambda r: (reads.add(1), r)[1]), schema.MEASUREMENTS)
    own = [rule(rule_id=f"r{x}", logic="OR", conditions=[rule(path=f"{x}/t", limit=2.0)["conditions"][0], rule(path=f"{x}/u", agg="avg", limit=4.0)["conditions"][0]]) for x in "abcdefgh"]
    rules, times = spark.createDataFrame(own, schema.RULES), spark.createDataFrame([("n", t) for t in (40, 60, 120, 500)], "node_id string, t_ns long")
    fired = points(rules_.evaluate_rules(m, views.keys(m), rules, times).where("fired"), "rule_id", "t_ns")
    assert fired and reads.value <= 6 * plain.count()
    reads.value = 0
    found = points(rules_.contexts(m, views.keys(m), rules, times).select("rule_id", "t_ns", "serie", F.to_json("context").alias("c")), "rule_id", "t_ns", "serie", "c")
    assert reads.value <= 8 * plain.count()
    hits = rules_.evaluate_rules(plain, views.keys(plain), rules, times).where("fired")
    assert found == points(rules_.context(hits, plain, views.keys(plain), rules).select("rule_id", "t_ns", "serie", F.to_json("context").alias("c")), "rule_id", "t_ns", "serie", "c")
    assert [r[:2] for r in found] == fired


def test_rules(spark):
    m = measure(spark, [("a/t", 10, 1), ("b/t", 20, 9), ("a/t", 30, 3)])
    times = spark.createDataFrame([("n", 30), ("n", 500)], "node_id string, t_ns long")

    def fired(r):
        return points(rules_.evaluate_rules(m, views.keys(m), spark.createDataFrame([r], schema.RULES), times), "t_ns", "fired")

    assert fired(rule()) == [(30, True), (500, False)]
    assert fired(rule(whole=True)) == [(30, False), (500, False)]
    assert fired(rule(agg="avg", limit=5.4, whole=True)) == [(30, True), (500, False)]
    assert fired(rule(agg="avg", limit=9.5)) == [(30, False), (500, False)]
    assert fired(rule(agg="count", op="==", limit=2.0)) == [(30, True), (500, False)]
    rules = spark.createDataFrame([rule()], schema.RULES)
    hits = rules_.evaluate_rules(m, views.keys(m), rules, times).where("fired")
    context = rules_.context(hits, m, views.keys(m), rules)
    assert context.select(F.to_json("context").alias("c")).first().c == '{"a/t":3.0,"b/t":9.0}'
    command = rules_.build_commands(context, rules).first()
    assert command.topic == "act/a"
    assert '"comando":"encender"' in command.value and '"velocidad":"alta"' in command.value and '"_x":"1"' in command.value and '"b/t":9.0' in command.value
    assert rules_.state(rules).first()[1:] == (1, 1)
    seen = []
    handlers = rules_.Handlers()
    handlers.register("publish", lambda c: seen.append(c.count()))
    handlers.run(rules_.build_commands(context, rules).where("kind != 'log'"))
    assert seen == [1]


def test_last_is_no_aggregate(spark):
    m = measure(spark, [("a/t", 10, 1), ("b/t", 20, 9)])
    times = spark.createDataFrame([("n", 30), ("n", 500)], "node_id string, t_ns long")
    made = [rule(rule_id="any", agg="last"), rule(rule_id="first", agg="last", whole=True, limit=0.5), rule(rule_id="low", agg="last", whole=True), rule(rule_id="odd", logic="XOR"), rule(rule_id="none", path="x/y"), rule(rule_id="bad", agg="median")]
    got = points(rules_.evaluate_rules(m, views.keys(m), spark.createDataFrame(made, schema.RULES), times).where("fired"), "rule_id", "t_ns")
    assert got == [("any", 30), ("first", 30), ("odd", 30)]


def test_rules_without_series_or_rules(spark):
    m = measure(spark, [("a/t", 10, 1)])
    times = spark.createDataFrame([("n", 30)], "node_id string, t_ns long")
    for made, want in (([rule(path="x/y"), rule(rule_id="w", path="x/*", agg="avg", whole=True)], [("r", False), ("w", False)]), ([], [])):
        rules = spark.createDataFrame(made, schema.RULES)
        fired = rules_.evaluate_rules(m, views.keys(m), rules, times)
        assert points(fired, "rule_id", "fired") == want
        assert rules_.build_commands(rules_.context(fired.where("fired"), m, views.keys(m), rules), rules).count() == 0


def test_rules_against_a_plain_evaluation(spark):
    """Any series, by intervals: rows at window edges, equal times, values that leave, evaluations between rows."""
    r = random.Random(4)
    rows = [(f"{r.choice('abc')}/t", r.randrange(0, 120), r.randrange(0, 10)) for _ in range(70)]
    m, ts = measure(spark, rows), list(range(0, 140, 3))
    times = spark.createDataFrame([("n", t) for t in ts], "node_id string, t_ns long")
    folds = {None: lambda x: max(x, key=lambda y: (y[1], -y[0]))[2], "avg": lambda x: sum(y[2] for y in x) / len(x), "count": len}
    made, want = [], []
    for k, (agg, fold) in enumerate(folds.items()):
        for w in (1, 20):
            made.append(rule(rule_id=f"{k}-{w}", agg=agg, window=w, limit=5.0))
            for t in ts:
                seen = [[(i, s, x) for i, (p, s, x) in enumerate(rows) if p == q and t - w <= s <= t] for q in ("a/t", "b/t", "c/t")]
                want.append((f"{k}-{w}", t, any(fold(x) > 5 for x in seen if x)))
    got = rules_.evaluate_rules(m, views.keys(m), spark.createDataFrame(made, schema.RULES), times)
    assert points(got, "rule_id", "t_ns", "fired") == sorted(want)


def test_failing_actions_stop_their_firing(spark):
    acts = [{"kind": k, "target": t, "params": {}} for k, t in (("a", "x"), ("b", "{gone}"), ("a", "y"))]
    rules = spark.createDataFrame([rule(actions=acts), rule(rule_id="s", actions=[acts[0], {"kind": "other", "target": "z", "params": {}}, acts[2]])], schema.RULES)
    m = measure(spark, [("a/t", 10, 9)])
    times = spark.createDataFrame([("n", 10), ("n", 20)], "node_id string, t_ns long")
    fired = rules_.evaluate_rules(m, views.keys(m), rules, times).where("fired")
    commands = rules_.build_commands(rules_.context(fired, m, views.keys(m), rules), rules)
    assert points(commands.where("t_ns = 10"), "rule_id", "step", "topic", "error") == [("r", 0, "x", None), ("r", 1, "", "empty topic"), ("s", 0, "x", None), ("s", 1, "z", None), ("s", 2, "y", None)]
    seen, handlers = [], rules_.Handlers()

    def run(c):
        seen.extend(points(c, "rule_id", "step", "t_ns"))
        return c.where("t_ns = 20")

    handlers.register("a", run)
    handlers.run(commands)
    assert seen == [("r", 0, 10), ("r", 0, 20), ("s", 0, 10), ("s", 0, 20), ("s", 2, 10)]
    handlers.register("a", lambda c: 1 / 0)
    handlers.run(commands)
    with pytest.raises(ValueError):
        handlers.register("", run)


def test_commands_to_files(spark, tmp_path):
    m, rules = measure(spark, [("a/t", 10, 9)]), spark.createDataFrame([rule()], schema.RULES)
    fired = rules_.evaluate_rules(m, views.keys(m), rules, spark.createDataFrame([("n", 10)], "node_id string, t_ns long")).where("fired")
    rules_.to_files(rules_.build_commands(rules_.context(fired, m, views.keys(m), rules), rules), f"{tmp_path}/out")
    assert points(spark.read.json(f"{tmp_path}/out"), "kind", "topic") == [("publish", "act/a")]


def test_rule_stream(spark, tmp_path):
    """Three batches: a window reaches back into earlier ones, and a repeated batch changes nothing."""
    for i, part in enumerate(([("a/t", 10, 9)], [("a/t", 60, 1), ("b/t", 70, 2)], [("a/t", 200, 8)])):
        measure(spark, part).write.parquet(f"{tmp_path}/in/{i}")
    series, rules = spark.createDataFrame([("n", "a/t"), ("n", "b/t")], "node_id string, path string"), spark.createDataFrame([rule(agg="max")], schema.RULES)
    rows = streams.with_time(spark.readStream.schema(schema.MEASUREMENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"))
    seen = []
    stream = streams.rule_stream(rows, series, rules, f"{tmp_path}/past", rules_.Handlers(), f"{tmp_path}/state", sink=lambda c: seen.extend(r.t_ns for r in c.collect()))
    stream.trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == [10, 60, 70, 200]


def test_a_late_row_counts_from_its_arrival(spark):
    m = measure(spark, [("a/t", 100, 1), ("a/t", 99, 9)])
    fired = rules_.replay(m, views.keys(m), spark.createDataFrame([rule(agg="avg", window=50, limit=4.0)], schema.RULES))
    assert points(fired, "t_ns", "seq") == [(99, 1)]
    # in order of time both count at 100
    times = spark.createDataFrame([("n", 99), ("n", 100)], "node_id string, t_ns long")
    assert points(rules_.evaluate_rules(m, views.keys(m), spark.createDataFrame([rule(agg="avg", window=50, limit=4.0)], schema.RULES), times).where("fired"), "t_ns") == [(99,), (100,)]


def plain_replay(rows, rule_, late=True):
    """(t_ns, seq) of the inserts (path, t_ns, value; seq is the place) at which a rule of one condition fires."""
    c, out = rule_["conditions"][0], []
    fold = {"avg": lambda x: sum(x) / len(x), "max": max, "min": min, "sum": sum, "count": len}
    for s, (_, t, _) in enumerate(rows):
        seen = {}
        for i, (p, u, x) in enumerate(rows[: s + 1]):
            if t - c["window_ns"] <= u <= t:
                seen.setdefault(p, []).append((u, -i, x))
        folded = [fold[c["agg"]]([x[2] for x in seen[p]]) if c["agg"] else max(seen[p])[2] for p in sorted(seen)]
        if c["aggregate_series"] and folded:
            folded = [fold[c["agg"]](folded)] if c["agg"] else folded[:1]
        if any(x > c["t_double"] for x in folded):
            out.append((t, s))
    return sorted(out)


@pytest.mark.parametrize("late", [0.1, 1])
def test_replay_in_arrival_order(spark, tmp_path, late):
    r = random.Random(late)
    rows = [(r.choice(["a/t", "b/t", "c/t"]), t if r.random() >= late else r.randrange(0, 400), r.randrange(10)) for t in sorted(r.randrange(400) for _ in range(90))]
    m = measure(spark, rows).repartition(3)
    made = [rule(rule_id=f"{agg}-{w}-{whole}", agg=agg, window=w, limit=x, whole=whole) for agg, x, w in ((None, 7.0, 13), ("avg", 5.5, 90), ("max", 8.0, 0)) for whole in (False, True)]
    fired = rules_.replay(m, views.keys(m), spark.createDataFrame(made, schema.RULES))
    want = {x["rule_id"]: plain_replay(rows, x) for x in made}
    got = {x["rule_id"]: [] for x in made}
    for f in fired.collect():
        got[f.rule_id].append((f.t_ns, f.seq))
    assert {k: sorted(x) for k, x in got.items()} == want

    # the stream of the same rows, in batches, gives the same commands
    some = made[:1] + made[2:3]
    for part in range(2):
        m.where(F.floor(F.col("seq") / 45) == part).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    seen = []
    stream = streams.rule_stream(streams.read(spark, f"{tmp_path}/in/*", 1), views.keys(m), spark.createDataFrame(some, schema.RULES), f"{tmp_path}/past", rules_.Handlers(), f"{tmp_path}/state", sink=lambda c: seen.extend((x.rule_id, x.t_ns, x.seq) for x in c.collect()))
    stream.trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == sorted((x["rule_id"], *p) for x in some for p in want[x["rule_id"]])


def test_windows_are_not_folded_again(spark):
    """No frame has a moving lower bound, whatever the window's length."""
    m = measure(spark, [("a/t", i, i % 7) for i in range(200)])
    keys = m.select("node_id", "path").distinct()
    rows, asks = windows.values(m), keys.join(m.select("node_id", F.col("ts_ns").alias("t_ns"), F.lit(windows.LAST_SEQ).alias("seq")), "node_id")
    for agg in ("max", "avg", "last"):
        found = windows.look(rows, asks, 20, agg)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "RangeFrame" not in plan and "unboundedpreceding" in plan.lower()
        got = {x.t_ns: x.num for x in found.collect()}
        fold = {"max": max, "avg": lambda x: sum(x) / len(x), "last": lambda x: x[-1]}[agg]
        assert got == {t: pytest.approx(fold([i % 7 for i in range(max(0, t - 20), t + 1)])) for t in range(200)}


def test_blocks_of_a_stream_are_in_arrival_order(spark, tmp_path):
    """A series with more rows in a batch than an Arrow part holds, out of order."""
    n = 30_000
    m = spark.range(n).select(F.lit("n").alias("node_id"), F.lit("a/t").alias("path"), (F.col("id") * 10).alias("ts_ns"), F.col("id").alias("seq"), F.lit("Real").alias("value_type"), F.col("id").cast("double").alias("v_double"), F.lit(None).cast("bigint").alias("v_long"), F.lit(None).cast("boolean").alias("v_bool"), F.lit(None).cast("string").alias("v_text"))
    m.orderBy(F.xxhash64("seq")).coalesce(1).write.parquet(f"{tmp_path}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, streams.ROCKSDB)
    try:
        made = streams.blocks(streams.read(spark, f"{tmp_path}/in"), 10)
        made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    got = points(spark.read.parquet(f"{tmp_path}/out"), "block", "t_start", "t_end", "n")
    assert got == [(i, 100 * i, 100 * i + 90, 10) for i in range(n // 10)]
    assert got == points(storage.blocks(m.withColumn("block_size", F.lit(10))), "block", "t_start", "t_end", "n")


def test_open_blocks_of_many_series_are_one_state():
    """Two batches of a group: one call each, and blocks go on where the batch before left them."""
    held = []

    class State:
        def exists(self):
            return bool(held)

        def get(self):
            return held[-1]

        def update(self, value):
            held.append(value)

    made = streams._Blocks(3)
    made.state = State()
    r = random.Random(3)
    rows = [(r.choice(["a", "b", "c", None]), s, 1000 - 7 * s) for s in range(41)]
    out = []
    for batch in (rows[:2], rows[2:20], rows[20:]):
        parts = [pd.DataFrame(batch[i::2], columns=["path", "seq", "ts_ns"]) for i in range(2)]
        out += [x for done in made.handleInputRows(("n", 0), iter(parts), None) for x in done.itertuples(index=False, name=None)]
    want = []
    for p in ("a", "b", "c", None):
        own = [t for q, _, t in rows if q == p]
        want += [("n", p, i, own[3 * i], own[3 * i + 2], 3) for i in range(len(own) // 3)]
    assert len(held) == 3 and sorted(out, key=str) == sorted(want, key=str)


def test_a_hot_series_is_numbered_in_slabs(spark):
    rows = [("a/t" if i % 10 else "b/t", i, i // 300 % 2) for i in range(2000)]
    m = measure(spark, rows)
    numbered = storage.number_blocks(m.withColumn("block_size", F.lit(7)))
    place, want = {}, {}
    for i, (p, _, _) in enumerate(rows):
        want[i] = place.get(p, 0) // 7
        place[p] = place.get(p, 0) + 1
    assert {r.seq: r.block for r in numbered.collect()} == want
    for frame in (numbered, encoding.runs(m, "v_double"), encoding.delta_of_delta(m)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        over = [x for x in plan.split("\n") if " Window [" in x or x.startswith("Window [")]
        assert over and all("slab" in x for x in over)
    runs = sorted((r.path, r.run, r.value, r.n, r.first_seq) for r in encoding.runs(m, "v_double").collect())
    flat = [(p, x) for p, _, x, n, _ in runs for _ in range(n)]
    assert flat == [(p, float(x)) for q in ("a/t", "b/t") for p, _, x in rows if p == q]
    assert max(n for *_, n, _ in runs) == 255
    back = encoding.undo_delta_of_delta(encoding.delta_of_delta(m))
    assert points(back, "path", "seq", "value") == sorted((p, i, t) for i, (p, t, _) in enumerate(rows))


def test_dense_buckets_are_linear(spark):
    m = measure(spark, [("a/t", 5, 1), ("a/t", 900_000, 2), ("b/t", 300_001, 3)])
    found = aggregate.bucket_aggregate(m, views.keys(m), "*/t", 0, 1_000_000, ["avg", "count"], 10)
    assert found.count() == 200_000
    assert points(found.where("avg is not null"), "path", "bucket", "avg", "count") == [("a/t", 0, 1.0, 1.0), ("a/t", 90_000, 2.0, 1.0), ("b/t", 30_000, 3.0, 1.0)]
    assert "map_from_entries" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_types_of_json_values(spark):
    given = ["1", "-7", "1.0", "1.5", "1e3", "true", '"x"', '""', "null", "{", "[1]", '{"a":1}', None, "9223372036854775807", "9223372036854775808"]
    got = storage.typed(spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, value string")).orderBy("i").collect()
    assert [r.value_type for r in got] == ["Integer", "Integer", "Real", "Real", "Real", "Boolean", "Text", "Text", None, None, None, None, None, "Integer", "Real"]
    assert [r.v_long for r in got[:2]] == [1, -7] and [r.v_double for r in got[2:5]] == [1.0, 1.5, 1000.0] and got[5].v_bool is True and got[6].v_text == "x" and got[14].v_double == 2.0**63


def test_a_bridge_that_is_restarted_sends_once(spark, tmp_path):
    subs = spark.createDataFrame([("t", "s1"), ("t", "s2")], "topic string, subscriber string")

    def put(name, ids):
        rows = [(i, "http", "{\"original\":true,\"topico\":\"t\",\"payload\":\"eA==\",\"interno\":false}") for i in ids]
        spark.createDataFrame(rows, "id long, origin string, value string").withColumn("ts", F.timestamp_seconds(F.col("id") + 1_700_000_000)).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        sent = spark.readStream.schema("id long, origin string, value string, ts timestamp").parquet(f"{tmp_path}/in/*")
        out = bridge.deliver_stream(sent, subs, ["id"], "1 hour").select("id", "dest", "subscriber")
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return points(spark.read.parquet(f"{tmp_path}/out"), "id", "dest", "subscriber")

    put("a", [1, 2, 2])
    once = run()
    assert once == [(i, d, s) for i in (1, 2) for d in ("coap", "http", "mqtt") for s in ("s1", "s2")]
    put("b", [2, 3, 1])
    assert run() == once + [(3, d, s) for d in ("coap", "http", "mqtt") for s in ("s1", "s2")]


def test_rules_with_a_glob_per_device(spark):
    """More globs than could be plan branches; each condition reads its own node's series."""
    n = 300
    conditions = spark.range(n).select(F.concat(F.lit("node_"), F.col("id") % 2).alias("node_id"), F.format_string("user_%04d/*", "id").alias("path"), F.lit(1).alias("pos"))
    conditions = conditions.unionByName(spark.createDataFrame([("node_0", "*/b", 2), ("node_1", "user_0001/a", 3), ("node_1", "[", 4)], "node_id string, path string, pos int"))
    series = spark.range(n).select(F.concat(F.lit("node_"), F.col("id") % 2).alias("node_id"), F.explode(F.array(*[F.format_string(f"user_%04d/{x}", "id") for x in "ab"])).alias("path"))
    got = sorted((r.node_id, r.pos, r.series_path) for r in rules_.bind(conditions, series).collect())
    want = [(f"node_{i % 2}", 1, f"user_{i:04d}/{x}") for i in range(n) for x in "ab"]
    want += [("node_0", 2, f"user_{i:04d}/b") for i in range(0, n, 2)] + [("node_1", 3, "user_0001/a")]
    assert got == sorted(want)


def test_globs_meet_the_catalog_by_their_rarest_segment(spark):
    paths = [f"dev{i}/{'temp' if i % 500 == 0 else 'other'}{'/x' if i % 3 == 0 else ''}" for i in range(3000)] + ["temp", "a//b", "dev7", "dev7/a/b/c"]
    series = spark.createDataFrame([("n", p) for p in paths], "node_id string, path string")
    globs = ["*/temp", "*/temp/*", "dev7/*", "*", "dev*/other/x", "?/*", "a//*", "dev[0-3]/temp*", "*/none", "dev7\\*", "*/*/x", "temp*"]
    conditions = spark.createDataFrame([("n", g) for g in globs], "node_id string, path string")
    got = points(rules_.bind(conditions, series), "path", "series_path")
    plain = points(conditions.join(series.withColumnRenamed("path", "series_path"), "node_id").where(F.rlike("series_path", glob.regex_of(F.col("path")))), "path", "series_path")
    assert got == plain and {g for g, _ in got} >= set(globs) - {"*/none", "dev7\\*"}
    spots = catalog.segments(series.withColumnRenamed("path", "series_path"), "series_path")
    chosen = {r.path: (r.pos, r.segment) for r in rules_.glob_keys(conditions, spots).collect()}
    assert chosen["*/temp"] == (1, "temp") and chosen["dev*/other/x"] == (2, "x") and chosen["*/none"] == (1, "none") and chosen["dev7/*"] == (0, "dev7")
    assert not {"*", "?/*", "temp*", "dev[0-3]/temp*"} & set(chosen)
    # what a glob is compared with is what has its segment
    assert spots.where("pos = 1 and segment = 'temp'").count() < len(paths) / 100


def test_rule_validation(spark):
    series = spark.createDataFrame([("n", "a/t", "Text"), ("n", "b/t", "Real")], "node_id string, path string, value_type string")
    bad = [rule(), rule(rule_id="w", window=0), rule(rule_id="o", op="=>"), rule(rule_id="g", agg="avg"), rule(rule_id="e", conditions=[], actions=[])]
    got = {r.rule_id: r.reasons for r in rules_.validate(spark.createDataFrame(bad, schema.RULES), series).collect()}
    assert got == {"r": [], "w": ["window"], "o": ["operator"], "g": ["aggregate_type"], "e": ["actions", "conditions"]}
    act = {"kind": "publish", "target": "a/{x}", "params": {}}
    more = [rule(rule_id="l", agg="last"), rule(rule_id="x", logic="XOR"), rule(rule_id="k", actions=[act | {"kind": "", "target": "a"}]), rule(rule_id="t", actions=[act | {"target": ""}]), rule(rule_id="v", actions=[act]), rule(rule_id="p", actions=[act | {"params": {"x": "1"}}])]
    got = {r.rule_id: r.reasons for r in rules_.validate(spark.createDataFrame(more, schema.RULES), series).collect()}
    assert got == {"l": [], "x": [], "k": ["action_kind"], "t": ["target"], "v": ["variables"], "p": []}


def test_registry(spark, tmp_path):
    (tmp_path / "good.json").write_text(
        '{"nodo_id":"n","series":{"a/t":{"serie_id":1,"path":"a/t","tags":{"k":"v"},"tipo_datos":"Real","compresion_bloque":"LZ4","compresion_bytes":"Xor","tamaño_bloque":7,"tiempo_almacenamiento":5}},'
        '"reglas":[{"id":"r","nombre":"x","activa":true,"logica":"AND","condiciones":[{"path":"a/t","ventana_t":"5m0s","agregacion":"promedio","operador":">","valor":1.5}],"acciones":[]}]}'
    )
    (tmp_path / "bad.json").write_text('{"nodo_id": ')
    nodes = registry.read(spark, str(tmp_path)).collect()
    assert [n.node_id for n in nodes] == ["n"]
    c = nodes[0].rules[0].conditions[0]
    assert (nodes[0].series["a/t"].block_size, c.window_ns, c.agg, c.t_double, c.t_text) == (7, 300_000_000_000, "avg", 1.5, None)


def test_registry_keeps_types_and_unknown_aggregates(spark, tmp_path):
    limits = [{"t_double": 56.0}, {"t_long": 7}, {"t_bool": True}, {"t_text": "on"}]
    none = dict.fromkeys(("t_double", "t_long", "t_bool", "t_text"))
    conditions = [{"path": "a/t", "window_ns": 1_500_000_000, "agg": a, "op": "==", "aggregate_series": False} | none | x for x, a in zip(limits, (None, "avg", "median", "last"), strict=True)]
    series = spark.createDataFrame([("n", 1, "a/t", {"k": "v"}, "Real", "Xor", "LZ4", 7, 5)], "node_id string, series_id int, path string, tags map<string,string>, value_type string, value_codec string, block_codec string, block_size int, retention_ns long")
    nodes = spark.createDataFrame([("n", "host", "80", {"site": "x"}), ("empty", None, None, None)], "node_id string, address string, http_port string, tags map<string,string>")
    registry.write(series, spark.createDataFrame([rule(conditions=conditions)], schema.RULES), f"{tmp_path}/r", nodes)
    got = {r.node_id: r for r in registry.read(spark, f"{tmp_path}/r", lines=True).collect()}
    back = got["n"].rules[0].conditions
    assert [(c.t_double, c.t_long, c.t_bool, c.t_text, c.agg) for c in back] == [(56.0, None, None, None, None), (None, 7, None, None, "avg"), (None, None, True, None, "median"), (None, None, None, "on", "last")]
    assert (got["n"].address, got["n"].http_port, got["n"].tags, back[0].window_ns) == ("host", "80", {"site": "x"}, 1_500_000_000)
    assert got["empty"].series is None


def test_percentiles(spark):
    import numpy as np

    from tidalgrid.operators import stats

    r = random.Random(2)
    groups = {"a": [r.gauss(0, 5) for _ in range(700)], "b": [1.0] * 50 + [2.0], "c": [3.5], None: [float(i) for i in range(1000)]}
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in [*xs, None]], "g string, v double")
    got = {x.g: x for x in stats.percentiles(rows, "g", "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}).collect()}
    for g, xs in groups.items():
        if g is not None:
            assert np.allclose([got[g].p0, got[g].p50, got[g].p95, got[g].p100], np.percentile(xs, [0, 50, 95, 100]))
    found = stats.latency_summary(rows.select("g", (F.col("v") * 1e6).alias("latency")), ["g"]).where("g is null").first()
    assert (found.n, found.median, found.p95) == (1000, 499.5, 949.05)


def test_empty_series_and_row_counts(spark):
    m = measure(spark, [("a", 1, 2), ("a", 2, 4), ("b", 900, 1)])
    got = aggregate.aggregate(m, views.keys(m), "*", 0, 10, ["avg", "count_rows"], keep_empty=True)
    assert points(got, "path", "avg", "count_rows") == [("a", 3.0, 2), ("b", None, None)]


def test_a_later_text_hides_a_number(spark):
    rows = [("n", "s", 1, 0, "Real", 5.0, None, None, None), ("n", "s", 1, 1, "Text", None, None, None, "x"), ("n", "s", 2, 2, "Real", 7.0, None, None, None), ("n", "s", 2, 3, "Real", None, None, None, None)]
    m = spark.createDataFrame(rows, schema.MEASUREMENTS)
    assert points(query.collapse_numbers(m), "ts_ns", "num") == sorted([(1, None), (2, 7.0)])
    assert points(aggregate.aggregate(m, views.keys(m), "s", 0, 9, ["sum"]), "sum") == [(7.0,)]


def test_envelopes_of_numbers_and_bytes(spark):
    for value, kind, text in ((5, "long", "5"), (1.5, "double", "1.5"), (bytearray(b"ab"), "binary", "ab"), ([1, 2], "array<int>", "[1,2]"), (None, "string", "")):
        sent = bridge.encode(spark.createDataFrame([("t", value)], f"topic string, payload {kind}")).select("value")
        assert bridge.decode(sent).first().payload == text


def test_nan_is_null_in_json(spark):
    rows = spark.createDataFrame([("n", "s", 0, 0, float("nan"))], "node_id string, path string, bucket long, start_ns long, avg double")
    assert render.bucket_json(rows, ["avg"]).first().value == '{"serie":"s","buckets":[0],"avg":[null]}'


def test_latency_files(spark, tmp_path):
    (tmp_path / "datos_http_mqtt_middleware.csv").write_text("1,3,2\n5,9,4\n")
    row = storage.read_latencies(spark, str(tmp_path)).orderBy("sent").first()
    assert (row.pub, row.sub, row.latency) == ("http", "mqtt", 2)
