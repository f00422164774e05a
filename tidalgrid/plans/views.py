"""Measurement, series, rule and message tables over the test tables, in Spark and in SQL.

Times are UTC; the session's time zone must be UTC. Hash functions differ between engines, so choices are arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY, HOUR = 86_400_000_000_000, 3_600_000_000_000
#: 2024-01-08, 2024-01-15, 2024-01-20 and 2024-01-30 in nanoseconds.
T0, T1, COLD_END, NOW = 1_704_672_000_000_000_000, 1_705_276_800_000_000_000, 1_705_708_800_000_000_000, 1_706_572_800_000_000_000
HOT_START = T1 - 5 * DAY
KINDS = ("click", "error", "purchase", "signup", "view")

EV = """ev AS (SELECT event_id, 'node_' || (user_id % 8) AS node_id, 'user_' || lpad(user_id::VARCHAR, greatest(4, length(user_id::VARCHAR))::INTEGER, '0') AS dev, user_id, event_type,
  epoch_us(ts) * 1000 AS ts_ns, event_id AS seq, value, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"""
KIND = f"""{EV}, m AS (SELECT node_id, dev || '/' || event_type AS path, ts_ns, seq, value AS v, k, user_id FROM ev)"""
TYPED = f"""{EV}, typed AS (
  SELECT node_id, dev || '/value' AS path, ts_ns, seq, 'Real' AS value_type, value AS v_double, NULL::BIGINT AS v_long, NULL::BOOLEAN AS v_bool, NULL::VARCHAR AS v_text, user_id FROM ev UNION ALL
  SELECT node_id, dev || '/k', ts_ns, seq, 'Integer', NULL, k, NULL, NULL, user_id FROM ev UNION ALL
  SELECT node_id, dev || '/high', ts_ns, seq, 'Boolean', NULL, NULL, value > 50, NULL, user_id FROM ev UNION ALL
  SELECT node_id, dev || '/event_type', ts_ns, seq, 'Text', NULL, NULL, NULL, event_type, user_id FROM ev)"""
TIERS = f"""{KIND}, cold AS (SELECT node_id, path, ts_ns, seq, v FROM m WHERE ts_ns < {COLD_END}),
  hot AS (SELECT node_id, path, ts_ns, seq, v + 1 AS v FROM m WHERE ts_ns >= {HOT_START})"""
SERIES = """series AS (SELECT node_id, path, min(user_id) AS user_id FROM m GROUP BY ALL)"""


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir: str) -> DataFrame:
    return shaped(table(spark, sf_dir, "events"))


def shaped(events_: DataFrame) -> DataFrame:
    """Events with node, device, nanoseconds and the number in their properties; batch or stream."""
    user = F.col("user_id").cast("string")
    return events_.select(
        "event_id", "user_id", "event_type", "value",
        F.concat(F.lit("node_"), (F.col("user_id") % 8).cast("string")).alias("node_id"),
        F.concat(F.lit("user_"), F.lpad(user, F.greatest(F.lit(4), F.length(user)), F.lit("0"))).alias("dev"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def _row(ev: DataFrame, metric, kind: str, **values) -> DataFrame:
    nulls = {"v_double": "double", "v_long": "bigint", "v_bool": "boolean", "v_text": "string"}
    cols = [values[c].alias(c) if c in values else F.lit(None).cast(t).alias(c) for c, t in nulls.items()]
    return ev.select("node_id", F.concat("dev", F.lit("/"), metric).alias("path"), "ts_ns", F.col("event_id").alias("seq"), F.lit(kind).alias("value_type"), *cols)


def by_kind(spark, sf_dir: str) -> DataFrame:
    """One real series for each user and event type."""
    return kind_rows(events(spark, sf_dir))


def kind_rows(ev: DataFrame) -> DataFrame:
    return _row(ev, F.col("event_type"), "Real", v_double=F.col("value"))


def typed(spark, sf_dir: str) -> DataFrame:
    """Four series for each user, one of each value type."""
    ev = events(spark, sf_dir)
    return (
        _row(ev, F.lit("value"), "Real", v_double=F.col("value"))
        .unionByName(_row(ev, F.lit("k"), "Integer", v_long=F.col("k")))
        .unionByName(_row(ev, F.lit("high"), "Boolean", v_bool=F.col("value") > 50))
        .unionByName(_row(ev, F.lit("event_type"), "Text", v_text=F.col("event_type")))
    )


def supplies(spark, sf_dir: str) -> DataFrame:
    """Series with repeated times: quantities by supplier and ship date; ``seq`` is a total order."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.lit("node_0").alias("node_id"), F.concat(F.lit("supp_"), F.col("l_suppkey").cast("string")).alias("path"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("ts_ns"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("seq"), F.lit("Real").alias("value_type"), F.col("l_quantity").alias("v_double"),
        F.lit(None).cast("bigint").alias("v_long"), F.lit(None).cast("boolean").alias("v_bool"), F.lit(None).cast("string").alias("v_text"),
    )


SUPPLIES = """m AS (SELECT 'node_0' AS node_id, 'supp_' || l_suppkey AS path, epoch_us(l_shipdate) * 1000 AS ts_ns, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS seq, l_quantity AS v FROM lineitem)"""


def tiers(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(hot, cold): both hold some days; hot values there are larger by 1."""
    m = by_kind(spark, sf_dir)
    return m.where(F.col("ts_ns") >= HOT_START).withColumn("v_double", F.col("v_double") + 1), m.where(F.col("ts_ns") < COLD_END)


def series(meas: DataFrame) -> DataFrame:
    """The catalog of the series that occur, with settings by arithmetic on the device number."""
    number = F.regexp_extract("path", r"^user_(\d+)/", 1).cast("long")
    own = meas.select("node_id", "path", "value_type").distinct().withColumn("u", number)
    return own.select(
        "node_id", (F.col("u") * 10 + F.length("path")).cast("int").alias("series_id"), "path",
        F.create_map(F.lit("device"), F.split("path", "/")[0], F.lit("metric"), F.split("path", "/")[1]).alias("tags"), "value_type",
        F.when(F.col("u") % 3 == 0, "RLE").when(F.col("u") % 3 == 1, "DeltaDelta").otherwise("Dictionary").alias("value_codec"), F.when(F.col("u") % 5 == 0, "Brotli").otherwise("ZSTD").alias("block_codec"),
        (F.col("u") % 7 * 2).cast("int").alias("block_size"), (F.col("u") % 4 * 5 * DAY).alias("retention_ns"),
    )


def keys(meas: DataFrame) -> DataFrame:
    return meas.select("node_id", "path").distinct()


def status(meas: DataFrame) -> DataFrame:
    return meas.select("node_id").distinct().withColumn("reachable", F.substring("node_id", 6, 9).cast("int") % 3 != 0)


def rules(spark, sf_dir: str) -> DataFrame:
    """One rule for each user with events: a high last click, and with every other user an average of all its series."""
    ev = events(spark, sf_dir)
    users = ev.groupBy("node_id", "dev", "user_id").agg(F.round(F.avg("value"), 3).alias("limit"))

    def condition(path, window, agg, op, limit, whole):
        return F.struct(path.alias("path"), F.lit(window).alias("window_ns"), F.lit(agg).cast("string").alias("agg"), F.lit(op).alias("op"), limit.alias("t_double"), F.lit(None).cast("bigint").alias("t_long"), F.lit(None).cast("boolean").alias("t_bool"), F.lit(None).cast("string").alias("t_text"), F.lit(whole).alias("aggregate_series"))

    first = condition(F.concat("dev", F.lit("/click")), 5 * DAY, None, ">", F.col("limit"), False)
    second = condition(F.concat("dev", F.lit("/view")), 10 * DAY, "avg", "<", F.col("limit") * 1.5, False)
    action = F.struct(F.lit("publish").alias("kind"), F.concat(F.lit("act/{serie_0}/{regla_id}/"), F.lit("{which}")).alias("target"), F.create_map(F.lit("which"), F.concat(F.lit("w"), (F.col("user_id") % 3).cast("string")), F.lit("comando"), F.lit("on")).alias("params"))
    return users.select(
        "node_id", F.concat(F.lit("rule_"), "dev").alias("rule_id"), F.concat(F.lit("Rule "), F.col("user_id").cast("string")).alias("name"), (F.col("user_id") % 5 != 0).alias("active"),
        F.when(F.col("user_id") % 2 == 0, "AND").otherwise("OR").alias("logic"), F.array(first, second).alias("conditions"), F.array(action).alias("actions"),
    )


def nodes(spark, sf_dir: str) -> DataFrame:
    """The registry: each node with its series and rules."""
    s, r = series(by_kind(spark, sf_dir)), rules(spark, sf_dir)
    own = s.groupBy("node_id").agg(F.collect_list(F.struct(F.col("path").alias("key"), F.struct("series_id", "path", "tags", "value_type").alias("value"))).alias("e")).select("node_id", F.map_from_entries("e").alias("series"))
    ruled = r.groupBy("node_id").agg(F.collect_list(F.struct("rule_id", "name", "active", "logic")).alias("rules"))
    return own.join(ruled, "node_id", "left")


def messages(spark, sf_dir: str) -> DataFrame:
    """Conversation turns as envelopes; every seventh is not JSON."""
    return enveloped(table(spark, sf_dir, "conversations"))


def enveloped(c: DataFrame) -> DataFrame:
    body = F.to_json(F.struct((F.col("turn") % 2 == 0).alias("original"), F.when(F.col("conv_id") % 11 == 0, F.concat(F.lit("$SYS/"), "role")).otherwise(F.col("role")).alias("topico"), F.base64(F.col("text").cast("binary")).alias("payload"), (F.col("conv_id") % 13 == 0).alias("interno")))
    origin = F.when(F.col("conv_id") % 3 == 0, "http").when(F.col("conv_id") % 3 == 1, "coap").otherwise("mqtt")
    return c.select("conv_id", "turn", origin.alias("origin"), F.when((F.col("conv_id") + F.col("turn")) % 7 == 6, F.lit("not json")).otherwise(body).alias("value"))


MESSAGES = """env AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'coap' ELSE 'mqtt' END AS origin, turn % 2 = 0 AS original,
  CASE WHEN conv_id % 11 = 0 THEN '$SYS/' || role ELSE role END AS topic, text AS payload, conv_id % 13 = 0 AS internal FROM conversations WHERE (conv_id + turn) % 7 <> 6)"""
