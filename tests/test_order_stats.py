"""Ranks in long rolling frames against brute force, over chunks, with ties and missing values."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import order_stats
from barloom.functions import rolling as W
from barloom.operators.levels import nearest_levels_history
from barloom.operators.order_stats import counts_below, frame_places, kth_smallest, next_above, rank_pct_long


def test_counts_below():
    r = np.random.default_rng(1)
    for top in (1, 2, 3, 7, 8, 100):
        rank = r.integers(0, top, 200)
        a = r.integers(0, 201, 300)
        b = np.minimum(200, a + r.integers(0, 90, 300))
        limit = r.integers(0, top + 1, 300)
        assert counts_below(rank, a, b, limit).tolist() == [int((rank[i:j] < v).sum()) for i, j, v in zip(a, b, limit)]
    assert counts_below(np.empty(0, np.int64), *(np.empty(0, np.int64),) * 3).tolist() == []


def test_frame_places():
    r = np.random.default_rng(2)
    x, known = r.integers(-3, 3, 150).astype(float), r.random(150) > 0.2
    for n in (1, 7, 40, 500):
        less, same, seen = frame_places(x, known, n)
        for i in range(150):
            part = slice(max(0, i - n + 1), i + 1)
            here = x[part][known[part]]
            assert seen[i] == len(here)
            if known[i]:
                assert (less[i], same[i]) == ((here < x[i]).sum(), (here == x[i]).sum())


@pytest.mark.parametrize("n,chunk", [(30, 50), (120, 10), (1000, 10)])
def test_long_frames_give_the_values_of_the_rolling_columns(spark, n, chunk):
    df = spark.range(700).select(
        F.when(F.col("id") % 10 < 7, "a").otherwise("b").alias("symbol"), F.col("id").alias("date"), F.lit("kept").alias("_note"),
        F.when(F.col("id") % 13 != 0, F.pmod(F.xxhash64("id"), F.lit(50)).cast("double")).alias("x"))
    d = rank_pct_long(df, "x", n, ["symbol"], ["date"], F.floor(F.col("date") / 90), min_periods=10, chunk_rows=chunk)
    want = df.withColumns({"rank_pct": W.rank_pct_rolling("x", n, min_periods=10), "pct_lt": W.pct_lt_tail("x", n), "pct_le": W.pct_le_tail("x", n)})
    assert d.columns == want.columns
    key = lambda r: (r.symbol, r.date)
    for a, b in zip(sorted(d.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert a[:4] == b[:4]
        assert all((u is None) == (v is None) and (u is None or abs(u - v) < 1e-12) for u, v in zip(a[4:], b[4:])), (a, b)


def test_no_frame_is_collected(spark):
    from barloom.plans import all_queries

    p = all_queries()[0]["wn_13_rank_long_ticks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in p and "FlatMapGroupsInArrow" in p


def test_kth_smallest_and_next_above():
    r = np.random.default_rng(4)
    rank = r.integers(0, 40, 300)
    a = r.integers(0, 250, 200)
    b = a + r.integers(1, 50, 200)
    k = (r.random(200) * (b - a)).astype(np.int64)
    assert kth_smallest(rank, a, b, k).tolist() == [int(np.sort(rank[i:j])[n]) for i, j, n in zip(a, b, k)]
    value, known = r.integers(0, 30, 120).astype(float), r.integers(0, 50, 120)
    x, at = r.integers(-1, 31, 400).astype(float), r.integers(-1, 55, 400)
    want = [min(value[(value > v) & (known <= t)], default=np.nan) for v, t in zip(x, at)]
    assert np.array_equal(next_above(value, known, x, at), want, equal_nan=True)


@pytest.mark.parametrize("most", [7, 40, 100_000])
def test_levels_of_every_row_are_those_of_the_rows_up_to_it(spark, most):
    r = np.random.default_rng(5)
    path = {"a": np.round(100 + np.cumsum(r.normal(size=120)), 1), "b": np.full(20, 5.0), "c": np.array([3.0])}
    day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(int(i))
    rows = [(s, day(i), float(v)) for s, values in path.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double")
    got = {(r.symbol, r.date): tuple(r[2:]) for r in nearest_levels_history(df, lookback=30, most_rows=most).collect()}
    want = {}
    for s, values in path.items():
        for t, v in enumerate(values):
            highs = [values[i] for i in range(5, t - 4) if values[i] == values[i - 5 : i + 5].max() and values[i] > v]
            lows = [values[i] for i in range(5, t - 4) if values[i] == values[i - 5 : i + 5].min() and values[i] < v]
            near = values[max(0, t - 29) : t + 1]
            want[s, day(t)] = (v, min(highs, default=near.max()), max(lows, default=near.min()))
    assert got == want


def test_default_chunks_are_small_and_keep_their_frames(spark):
    import inspect

    for f in (order_stats.rolling_places, order_stats.rank_pct_long):
        assert inspect.signature(f).parameters["chunk_rows"].default <= 250_000
    n = 250_200  # the last rows lie in a second chunk
    df = spark.range(n).selectExpr("'a' AS k", "id", "pmod(id * 7919, 10007) / 3.0D AS x")
    got = order_stats.rolling_places(df, "x", 600, ["k"], ["id"], F.lit(0)).filter("id >= 249500").orderBy("id").collect()
    i = np.arange(n)
    less, same, known = order_stats.frame_places(i * 7919 % 10007 / 3.0, np.ones(n, bool), 600)
    assert [(r.less, r.same, r.known) for r in got] == list(zip(less[249500:].tolist(), same[249500:].tolist(), known[249500:].tolist()))
