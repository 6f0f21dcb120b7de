"""Registered queries against their SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from barloom.plans import all_queries

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUERIES, ORACLE = all_queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def order_key(row):
    return tuple((v is not None, round(v, 2) if isinstance(v, float) else v) for v in row)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-2 if abs(a) > 1000 else 2e-4)
    return a == b


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=order_key)
    res = con.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=order_key)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 5
