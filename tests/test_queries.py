"""Every registered query against its SQL, on whole tables."""

import pytest
from compare import connect, duck_rows, spark_rows
from conftest import SMALL

import __spark_entry__ as driver

QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, SMALL))
    expected_columns, expected = duck_rows(con, SQL[name])
    assert columns == expected_columns
    assert rows == expected


def test_entry_has_rows(spark):
    assert not driver.entry(spark).isEmpty()
