"""Topic templates with ``{name}`` variables, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VARIABLE = r"\{([a-zA-Z_][a-zA-Z0-9_]*)\}"
#: Variables that every fired rule provides.
CONTEXT = ("serie", "serie_0", "serie_1", "serie_2", "serie_3", "serie_4", "serie_5", "regla_id", "regla_nombre")


def variables(template: Column) -> Column:
    """Distinct variable names in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(VARIABLE), F.lit(1)))


def valid(template: Column) -> Column:
    """Braces are balanced, not nested, and hold valid names."""
    return ~F.regexp_replace(template, VARIABLE, "").rlike("[{}]")


def missing(template: Column, params: Column) -> Column:
    """Variables that neither the parameters nor the context provide."""
    return F.array_except(variables(template), F.concat(F.map_keys(params), F.array(*[F.lit(c) for c in CONTEXT])))


def resolve(template: Column, params: Column, rule_id: Column, rule_name: Column, path: Column) -> Column:
    """Parameters in entry order, then the rule, then the series and its segments; what is left becomes empty."""
    pairs = F.map_entries(F.coalesce(params, F.create_map().cast("map<string,string>")))
    out = F.aggregate(pairs, template, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))
    parts = F.split(path, "/")
    values = {"regla_id": rule_id, "regla_nombre": rule_name, "serie": path} | {f"serie_{i}": F.get(parts, i) for i in range(6)}
    for name, value in values.items():
        out = F.when(value.isNotNull(), F.replace(out, F.lit("{" + name + "}"), value)).otherwise(out)
    return F.regexp_replace(out, VARIABLE, "")
