"""The message bridge: envelopes, fan-out between protocols, delivery to subscribers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = "original boolean, topico string, payload string, interno boolean"
#: Where messages of each origin go.
ROUTES = (("http", "http"), ("http", "coap"), ("http", "mqtt"), ("coap", "http"), ("coap", "coap"), ("coap", "mqtt"), ("mqtt", "coap"), ("mqtt", "http"))


def decode(messages: DataFrame, value: str = "value") -> DataFrame:
    """Envelopes of JSON ``value``: ``original, topic, payload, internal``; undecodable ones and empty topics are dropped."""
    keep = [c for c in messages.columns if c != value]
    e = messages.withColumn("_e", F.from_json(value, ENVELOPE))
    payload = F.unbase64(F.col("_e.payload")).cast("string")
    return e.where("_e is not null and coalesce(_e.topico, '') != ''").select(*keep, F.coalesce("_e.original", F.lit(False)).alias("original"), F.col("_e.topico").alias("topic"), payload.alias("payload"), F.coalesce("_e.interno", F.lit(False)).alias("internal"))


def encode(rows: DataFrame) -> DataFrame:
    """``topic`` and ``payload`` as JSON envelopes that count as originals. Texts and bytes are taken as they are, numbers as
    text, anything else as JSON; null is an empty payload."""
    kind = rows.schema["payload"].dataType
    plain = isinstance(kind, (T.StringType, T.BinaryType, T.NumericType))
    own = F.col("payload").cast("string") if isinstance(kind, T.NumericType) else F.col("payload") if plain else F.to_json(F.struct("payload")).substr(F.lit(12), F.length(F.to_json(F.struct("payload"))) - 12)
    packed = F.coalesce(F.base64(own.cast("binary")), F.lit(""))
    body = F.struct(F.lit(True).alias("original"), F.col("topic").alias("topico"), F.replace(packed, F.lit("\r\n"), F.lit("")).alias("payload"), F.lit(False).alias("interno"))
    return rows.withColumn("value", F.to_json(body))


def fan_out(messages: DataFrame, routes: tuple = ROUTES) -> DataFrame:
    """Copies of original messages to each destination of their ``origin``; copies aren't originals, so they go no further.
    System topics and internal messages are ignored."""
    known = F.array(*[F.struct(F.lit(a).alias("origin"), F.lit(b).alias("dest")) for a, b in routes])
    own = messages.where(F.col("original") & ~F.col("topic").startswith("$SYS/") & ~F.col("internal"))
    dests = F.transform(F.filter(known, lambda r: r["origin"] == F.col("origin")), lambda r: r["dest"])
    return own.withColumn("dest", F.explode(dests)).withColumn("original", F.lit(False))


def deliver(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row for each subscriber of a message's exact topic; messages without subscribers are dropped."""
    return messages.join(subscriptions, "topic")


def deliver_stream(messages: DataFrame, subscriptions: DataFrame, ids: list[str], delay: str, time: str = "ts") -> DataFrame:
    """A stream of envelopes (``value``, ``origin``, ``ids``, an event ``time``) as it reaches the subscribers. A message that comes again
    within ``delay`` is sent once; state is freed after that. ``subscriptions`` is a table, read anew for each micro-batch."""
    own = messages.withWatermark(time, delay).dropDuplicatesWithinWatermark(ids)
    return deliver(fan_out(decode(own)), subscriptions)
