"""Corpus queries with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from barloom import llm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = llm.queries()[name](spark, SF)
    found = con.execute(llm.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    rows = [tuple(r[c] for c in names) for r in df.collect()]
    assert sorted(rows, key=repr) == sorted(found.fetchall(), key=repr)
