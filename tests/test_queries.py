"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import pytest

from kindred.queries import oracle_sql, queries

from . import compare

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.views(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, con, name):
    assert compare.differences(QUERIES[name](spark, sf_dir), con, SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
