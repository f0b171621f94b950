"""Every query that SQL can express, against DuckDB over the same tables."""

import os

import duckdb
import pytest

import __spark_entry__

QUERIES = __spark_entry__.queries()
ORACLE = __spark_entry__.oracle_sql()
OWN = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for name in os.listdir(tiny):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{tiny}/{name}'")
    return con


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, tiny, name):
    found = QUERIES[name](spark, tiny)
    columns = sorted(found.columns)
    rows = _sorted(found.select(*columns).collect())
    if name not in ORACLE:
        assert rows
        return
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    assert rows == _sorted(want.select(*columns).fetchall())


def test_oracles_have_queries():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
