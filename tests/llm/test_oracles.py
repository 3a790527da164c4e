"""The SQL-expressible queries against their SQL."""

import os

import pytest

from gleaner.llm import queries
from tests.test_oracles import TABLES, rows_of

SF = os.environ.get("TEST_ORACLE_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    found = duck.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(found.columns, found.fetchall())
