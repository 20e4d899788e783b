"""Every registered query of the reading operators against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from quire.plans import all_queries, all_sql

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return f"{float(value):.6g}"
    return value


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, DATA)
    columns = sorted(df.columns)
    told = duck.sql(all_sql()[name])
    assert columns == sorted(told.columns)
    got = sorted(repr([plain(x) for x in r]) for r in df.select(*columns).collect())
    want = sorted(repr([plain(x) for x in r]) for r in told.select(*[f'"{c}"' for c in columns]).fetchall())
    assert got == want


def test_every_query_has_its_sql():
    assert set(all_queries()) == set(all_sql())
