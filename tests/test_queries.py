"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import pytest

import __spark_entry__ as entry
from workload.check import compare, connect

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        assert compare(df, SQL[name], con) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 11 and "benign_percent" in df.columns


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
