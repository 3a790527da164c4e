"""Every query against its SQL, as the driver compares them."""

import math
import os

import duckdb
import pytest

from gleaner.plans import catalogue

SF = os.environ.get("TEST_ORACLE_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    assert name in catalogue.ORACLES
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.sql(catalogue.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(found.columns, found.fetchall())
    assert len(got) == len(want) and len(got) > 0
    assert got == want
