"""Queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from lexshard.plans import queries as index

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", index.SQL)
def test_query(spark, duck, name):
    got = index.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(index.oracle_sql()[name])
    assert sorted(want.columns) == cols
    rows = sorted(map(repr, (tuple(r[c] for c in cols) for r in got.collect())))
    at = [want.columns.index(c) for c in cols]
    assert rows == sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall())))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["value"]
    assert set(e.oracle_sql()) <= set(e.queries())
