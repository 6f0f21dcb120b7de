"""Top-k search: components of any size and repeated ids, against whole-number brute force and the query's SQL."""

import collections
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import topk

MOST = (1 << 63) - 1


def brute(rows, queries, k):
    lists = collections.defaultdict(list)
    for q, v in queries:
        lists[q] += [(-max(-MOST, min(MOST, sum(a * b for a, b in zip(v, w)))), i) for i, w in rows if i != q and len(w) == len(v)]
    return sorted((q, n + 1, i, -s) for q, found in lists.items() for n, (s, i) in enumerate(sorted(found)[:k]))


@pytest.mark.parametrize("sizes", [(2,), (2, 1e6), (2, 1e9), (2, 1e6, 1e12, 1e17, 1e300), (1e200,)])
def test_components_of_any_size(spark, sizes):
    r = random.Random(len(sizes))
    rows = [(i, [r.uniform(-1, 1) * s for _ in range(9)]) for i in range(160) for s in [r.choice(sizes)]]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumn("vector", topk.scaled(F.col("vector")))
    whole = [(i, [max(-MOST - 1, min(MOST, int(np.floor(64 * x)))) for x in v]) for i, v in rows]
    got = topk.top_k(df, df.filter("vec_id % 8 = 0"), k=6, block=50)
    assert sorted(map(tuple, got.collect())) == brute(whole, [x for x in whole if x[0] % 8 == 0], 6)


def test_repeated_ids_are_rows_of_their_own(spark):
    r = random.Random(9)
    rows = [(r.randrange(40), [float(r.randrange(-3, 4)) for _ in range(4)]) for _ in range(200)]
    rows += [(7, [3.0, 3.0, 3.0, 3.0])] * 100 + [(21, []), (22, None), (None, [1.0] * 4)]
    rows = [x for n, x in enumerate(rows) if x[0] not in (0, 20) or x not in rows[:n]]  # equal query rows: below
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [i for i, _ in rows], "embedding": [v for _, v in rows]}, pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64()))])))
    whole = [(i, [int(64 * x) for x in v]) for i, v in rows if i is not None and v]
    want = brute(whole, [x for x in whole if x[0] % 20 == 0], 20)
    assert want == sorted(con.execute(topk.ORACLE_SQL).fetchall())
    for again in ([], [x for x in rows if x[0] == 20]):  # an equal row of a query is one query
        df = spark.createDataFrame(rows + again * 2, "vec_id long, embedding array<double>").withColumn("vector", topk.scaled(F.col("embedding")))
        got = sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 20 = 0"), k=20, block=30).filter("query_id = 20").collect()))
        assert got == [x for x in want if x[0] == 20]
