"""Comparison of a measured value with a threshold.

Numbers compare with numbers, equality within 1e-9, and NaN with nothing; texts without regard to case and booleans,
both by ``==`` and ``!=`` only. Anything else is false, never null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def compare(value: dict[str, Column], op: Column, threshold: dict[str, Column]) -> Column:
    """``value`` and ``threshold`` have the columns ``number``, ``bool`` and ``text``, of which one at most isn't null."""
    a, b = value["number"], threshold["number"]
    near = F.abs(a - b) < EPSILON
    number = F.when(op == ">", a > b).when(op == ">=", a >= b).when(op == "<", a < b).when(op == "<=", a <= b).when(op == "==", near | (a == b)).when(op == "!=", ~(near | (a == b)))
    number = ~F.isnan(a) & ~F.isnan(b) & number

    def equality(x: Column, y: Column) -> Column:
        return F.when(op == "==", x == y).when(op == "!=", x != y)

    kinds = (
        F.when(a.isNotNull() & b.isNotNull(), number)
        .when(value["text"].isNotNull() & threshold["text"].isNotNull(), equality(F.lower(value["text"]), F.lower(threshold["text"])))
        .when(value["bool"].isNotNull() & threshold["bool"].isNotNull(), equality(value["bool"], threshold["bool"]))
    )
    return F.coalesce(kinds, F.lit(False))
