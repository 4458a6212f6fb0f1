"""Every registered query against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import TESTDATA

MORE = entry._more()
QUERIES = {k: v for k, v in entry.queries().items() if k not in MORE[0]}
SQL = {k: v for k, v in entry.oracle_sql().items() if k not in MORE[1]}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in entry._TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{TESTDATA}/{t}.parquet')")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, TESTDATA)
    columns = sorted(df.columns)
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert columns == sorted(names)
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == expected and got


def test_entry(spark):
    assert entry.entry(spark).count() == 9
