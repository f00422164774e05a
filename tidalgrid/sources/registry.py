"""The node registry as JSON files, one for each node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The document's field names.
DOCUMENT = (
    "nodo_id string, direccion string, puerto_http string, tags map<string,string>, "
    "series map<string, struct<serie_id: int, path: string, tags: map<string,string>, tipo_datos: string, compresion_bloque: string, "
    "compresion_bytes: string, `tamaño_bloque`: int, tiempo_almacenamiento: bigint>>, "
    "reglas array<struct<id: string, nombre: string, activa: boolean, logica: string, "
    "condiciones: array<struct<path: string, ventana_t: string, agregacion: string, operador: string, valor: variant, agregar_series: boolean>>, "
    "acciones: array<struct<tipo: string, destino: string, params: map<string,string>>>>>, _corrupt_record string"
)
#: Nanoseconds of duration units, and aggregate names in documents.
UNITS = {"h": 3_600_000_000_000, "m": 60_000_000_000, "s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "µs": 1_000, "ns": 1}
AGGREGATES = {"promedio": "avg", "maximo": "max", "minimo": "min", "suma": "sum", "count": "count"}


def duration_ns(text: Column) -> Column:
    """Nanoseconds of a duration like ``1h5m0.5s``; null if it isn't one."""
    units = "h|ms|m|s|us|µs|ns"
    part = F.regexp_extract_all(text, F.lit(rf"(\d+(?:\.\d+)?({units}))"), F.lit(1))

    def one(p: Column) -> Column:
        unit, out = F.regexp_extract(p, rf"({units})$", 1), F.lit(0)
        for u, ns in UNITS.items():
            out = F.when(unit == u, ns).otherwise(out)
        return (F.regexp_extract(p, r"^[\d.]+", 0).cast("decimal(20,9)") * out).cast("long")

    return F.when(text.rlike(rf"^(\d+(\.\d+)?({units}))+$"), F.aggregate(part, F.lit(0).cast("long"), lambda acc, p: acc + one(p)))


def read(spark, path: str, lines: bool = False) -> DataFrame:
    """Nodes with their series and rules from files of one document each, or with ``lines`` of one in each line; malformed ones
    are skipped."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    return shape(raw.where("_corrupt_record is null"))


def shape(raw: DataFrame) -> DataFrame:
    series = F.transform_values(
        "series",
        lambda _, s: F.struct(
            s["serie_id"].alias("series_id"), s["path"].alias("path"), s["tags"].alias("tags"), s["tipo_datos"].alias("value_type"), s["compresion_bytes"].alias("value_codec"),
            s["compresion_bloque"].alias("block_codec"), s["tamaño_bloque"].alias("block_size"), s["tiempo_almacenamiento"].alias("retention_ns"),
        ),
    )
    agg = F.create_map(*[F.lit(x) for kv in AGGREGATES.items() for x in kv])

    def typed(c: Column, kind: str, names: tuple[str, ...]) -> Column:
        return F.when(F.schema_of_variant(c["valor"]).isin(*names) | F.schema_of_variant(c["valor"]).startswith("DECIMAL" if kind == "double" else "-"), F.try_variant_get(c["valor"], "$", kind))

    condition = lambda c: F.struct(
        c["path"].alias("path"), duration_ns(c["ventana_t"]).alias("window_ns"), F.when(c["agregacion"] != "", F.coalesce(F.try_element_at(agg, c["agregacion"]), c["agregacion"])).alias("agg"), c["operador"].alias("op"),
        typed(c, "double", ("DOUBLE", "FLOAT")).alias("t_double"), typed(c, "bigint", ("BIGINT",)).alias("t_long"), typed(c, "boolean", ("BOOLEAN",)).alias("t_bool"), typed(c, "string", ("STRING",)).alias("t_text"),
        F.coalesce(c["agregar_series"], F.lit(False)).alias("aggregate_series"),
    )
    rules = F.transform("reglas", lambda r: F.struct(r["id"].alias("rule_id"), r["nombre"].alias("name"), r["activa"].alias("active"), r["logica"].alias("logic"), F.transform(r["condiciones"], condition).alias("conditions"), F.transform(r["acciones"], lambda a: F.struct(a["tipo"].alias("kind"), a["destino"].alias("target"), a["params"].alias("params"))).alias("actions")))
    return raw.select(F.col("nodo_id").alias("node_id"), F.col("direccion").alias("address"), F.col("puerto_http").alias("http_port"), "tags", series.alias("series"), rules.alias("rules"))


def duration_text(ns: Column) -> Column:
    """A duration like ``1h0m0s`` or ``0.5s`` (hours and minutes left out from the front)."""
    h, m = F.floor(ns / UNITS["h"]), F.floor(ns / UNITS["m"]) % 60
    s = (ns % UNITS["m"]) / 1e9
    seconds = F.concat(F.regexp_replace(F.regexp_replace(F.format_string("%.9f", s), "0+$", ""), r"\.$", ""), F.lit("s"))
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h"), m.cast("string"), F.lit("m"), seconds)).when(m > 0, F.concat(m.cast("string"), F.lit("m"), seconds)).otherwise(seconds)


def documents(series: DataFrame, rules: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node_id, value): the JSON document of each node: series by path, rules sorted by id, windows as duration text,
    thresholds with their types. ``nodes`` (node_id, address, http_port, tags) adds these; a node may have nothing else.
    """
    back = F.create_map(*[F.lit(x) for k, v in AGGREGATES.items() for x in (v, k)])
    entry = F.struct(F.col("path").alias("key"), F.struct(F.col("series_id").alias("serie_id"), "path", "tags", F.col("value_type").alias("tipo_datos"), F.col("block_codec").alias("compresion_bloque"), F.col("value_codec").alias("compresion_bytes"), F.col("block_size").alias("tamaño_bloque"), F.col("retention_ns").alias("tiempo_almacenamiento")).alias("value"))
    own = series.groupBy("node_id").agg(F.collect_list(entry).alias("_s"))
    own = own.select("node_id", F.map_from_entries("_s").alias("series"))
    condition = lambda c: F.struct(c["path"].alias("path"), duration_text(c["window_ns"]).alias("ventana_t"), F.coalesce(F.try_element_at(back, c["agg"]), c["agg"]).alias("agregacion"), c["op"].alias("operador"), F.coalesce(c["t_double"].cast("variant"), c["t_long"].cast("variant"), c["t_bool"].cast("variant"), c["t_text"].cast("variant")).alias("valor"), c["aggregate_series"].alias("agregar_series"))
    rule = F.struct(F.col("rule_id").alias("id"), F.col("name").alias("nombre"), F.col("active").alias("activa"), F.col("logic").alias("logica"), F.transform("conditions", condition).alias("condiciones"), F.transform("actions", lambda a: F.struct(a["kind"].alias("tipo"), a["target"].alias("destino"), a["params"].alias("params"))).alias("acciones"))
    ruled = rules.groupBy("node_id").agg(F.array_sort(F.collect_list(rule), lambda x, y: F.when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0)).alias("reglas"))
    both = own.join(ruled, "node_id", "full_outer")
    if nodes is None:
        return both.select("node_id", F.to_json(F.struct(F.col("node_id").alias("nodo_id"), "series", "reglas")).alias("value"))
    both = both.join(nodes.select("node_id", F.col("address").alias("direccion"), F.col("http_port").alias("puerto_http"), "tags"), "node_id", "full_outer")
    return both.select("node_id", F.to_json(F.struct(F.col("node_id").alias("nodo_id"), "direccion", "puerto_http", "series", "tags", "reglas")).alias("value"))


def write(series: DataFrame, rules: DataFrame, path: str, nodes: DataFrame | None = None) -> None:
    """Documents as text files, a line for each node; ``read`` takes them with ``lines``."""
    documents(series, rules, nodes).select("value").write.mode("overwrite").text(path)
