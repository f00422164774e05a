"""Comparison of Spark rows with DuckDB's, and small measurement tables."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or isinstance(x, float) and x != x:
        return None
    return round(x, 5) if isinstance(x, float) else x


def oracle(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.sql(sql)
    return found.columns, found.fetchall()


def assert_same(df, sql: str, sf_dir: str) -> None:
    columns, rows = oracle(sql, sf_dir)
    names = sorted(df.columns)
    assert names == sorted(columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    want = sorted(repr([plain(r[columns.index(c)]) for c in names]) for r in rows)
    assert got == want


def measure(spark, rows):
    """Real measurements from (path, ts_ns, value); arrival order is list order."""
    from tidalgrid import schema

    return spark.createDataFrame([("n", p, t, i, "Real", None if v is None else float(v), None, None, None) for i, (p, t, v) in enumerate(rows)], schema.MEASUREMENTS)
