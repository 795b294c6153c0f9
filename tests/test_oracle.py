"""Every own query with SQL against DuckDB over the smallest tables."""

import math
import os

import duckdb
import pytest

from kinespark import queries as Q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return f"{float(v):.5f}".replace("-0.00000", "0.00000")
    return str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[k]) for k in names) for r in df.collect())
    rel = duck.sql(Q.ORACLE_SQL[name])
    assert sorted(rel.columns) == names
    places = [rel.columns.index(k) for k in names]
    assert got == sorted(tuple(plain(r[k]) for k in places) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(Q.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
