"""Every registered query with SQL gives DuckDB's rows; the others run."""

from __future__ import annotations

import helpers
import pytest

from tidalgrid.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, name):
    helpers.assert_same(queries.QUERIES[name](spark, sf), queries.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["node_id", "path", "bucket", "start_ns", "avg", "max"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
