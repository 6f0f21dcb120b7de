"""Hand-made frames: warm-up, ties, constants, gaps, and brute-force counterparts."""

import datetime as dt
import math
import random
import re

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.functions import rolling as W
from barloom.functions import scalar as S
from barloom.operators import align as A
from barloom.operators import backtest as B
from barloom.operators import market as M
from barloom.operators import options as OC
from barloom.operators import ranking as R
from barloom.operators import signals as G
from barloom.operators import text as T
from barloom.operators.chunking import chunked, drop_halo, number_rows, running_total
from barloom.operators.flows import streaks
from barloom.operators.levels import swing_points
from barloom.operators.smoothing import with_ewm
from barloom.sources import readers, sinks

DAY0 = dt.date(2024, 1, 1)


def series(spark, values, symbol="A", step=1):
    rows = [(symbol, DAY0 + dt.timedelta(days=i * step), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, date date, close double")


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_warm_up_is_missing_until_the_frame_is_full(spark):
    d = series(spark, range(1, 7)).withColumns({"m": W.sma("close", 3), "s": W.rolling_std("close", 3)})
    assert column(d, "m") == [None, None, 2.0, 3.0, 4.0, 5.0]
    assert column(d, "s")[:2] == [None, None] and column(d, "s")[2] == pytest.approx(1.0)


def test_single_row_has_no_deviation(spark):
    assert column(series(spark, [5]).withColumn("s", W.rolling(F.stddev_samp, "close", 2, min_periods=1)), "s") == [None]


def test_constant_series_gives_missing_not_error(spark):
    d = series(spark, [7] * 30).withColumns({
        "z": W.zscore("close", 5), "p": W.range_position("close", 5), "c": W.rolling_corr("close", "close", 5)})
    for name in "zpc":
        assert set(column(d, name)) == {None}


def test_average_rank_on_ties(spark):
    d = series(spark, [1, 2, 2, 2, 3]).withColumns({
        "full": W.rank_pct_full("close"), "roll": W.rank_pct_rolling("close", 5), "le": W.pct_le_full("close"),
        "lt": W.pct_lt_tail("close", 5)})
    assert column(d, "full") == pytest.approx([0.2, 0.6, 0.6, 0.6, 1.0])
    assert column(d, "roll")[-1] == pytest.approx(1.0) and column(d, "roll")[0] is None
    assert column(d, "le")[1] == pytest.approx(0.8) and column(d, "lt")[-1] == pytest.approx(0.8)


def test_ewm_equals_pandas(spark):
    rng = random.Random(3)
    values = [None] + [rng.uniform(0, 100) for _ in range(900)]
    d = with_ewm(series(spark, values), {"a": "close"}, 2 / 15)
    d = with_ewm(d, {"b": "close"}, 1 / 14, adjust=True, min_periods=14)
    s = pd.Series(values, dtype=float)
    for name, want in (("a", s.ewm(span=14, adjust=False).mean()),
                       ("b", s.ewm(alpha=1 / 14, min_periods=14).mean())):
        for got, w in zip(column(d, name), want):
            assert (got is None) == math.isnan(w)
            assert got is None or got == pytest.approx(w, rel=1e-11)


def test_clip_and_ladder_keep_missing(spark):
    d = series(spark, [None, -5, 0, 5]).select("date", S.clip("close", -1, 1).alias("c"),
                                                S.ladder("close", [(">", 1.0, "HI")], "LO", "NA").alias("l"))
    assert column(d, "c") == [None, -1.0, 0.0, 1.0]
    assert column(d, "l") == ["NA", "LO", "LO", "HI"]


def test_names_and_columns_build_the_same(spark):
    d = series(spark, [3, 1, 2, 5, 4])
    x = F.col("close")
    for f in (lambda c: W.sma(c, 2), lambda c: W.pct_change(c), lambda c: W.diff(c), lambda c: W.lag(c, 2),
              lambda c: W.carried(c), lambda c: S.clip(c, 2, 4)):
        assert column(d.withColumn("v", f("close")), "v") == column(d.withColumn("v", f(x)), "v")


def _brute_asof(left, right, forward=False):
    out = {}
    for k, t, i in left:
        side = [(rt, v) for rk, rt, v in right if rk == k and (rt >= t if forward else rt <= t)]
        out[i] = (min if forward else max)(side)[1] if side else None
    return out


@pytest.mark.parametrize("forward", [False, True])
def test_asof_join_equals_brute_force(spark, forward):
    rng = random.Random(5)
    day = lambda n: DAY0 + dt.timedelta(days=n)
    # one key holds most rows; another has right rows only, a third left rows only
    left = [("hot" if rng.random() < 0.8 else rng.choice(["b", "l"]), day(rng.randrange(1500)), i) for i in range(400)]
    right = sorted({(rng.choice(["hot", "b", "r"]), day(rng.randrange(1500))) for _ in range(60)})
    right = [(k, t, float(j)) for j, (k, t) in enumerate(right)]
    l = spark.createDataFrame(left, "symbol string, date date, id int")
    r = spark.createDataFrame(right, "symbol string, date date, v double")
    got = A.asof_join(l, r, ["v"], direction="forward" if forward else "backward")
    assert {x["id"]: x["v"] for x in got.collect()} == _brute_asof(left, right, forward)


def test_nearest_prefers_the_earlier_date_on_a_tie(spark):
    bars = series(spark, [1, 2, 3], step=4)
    ev = spark.createDataFrame([("A", DAY0 + dt.timedelta(days=2)), ("A", DAY0 + dt.timedelta(days=7))], "symbol string, date date")
    got = {r["date"].day: r["close"] for r in A.nearest_asof(ev, bars, ["close"]).collect()}
    assert got == {3: 1.0, 8: 3.0}


def test_nth_bar_is_strictly_after(spark):
    bars = series(spark, [10, 11, 12], step=2)
    ev = spark.createDataFrame([("A", DAY0), ("A", DAY0 + dt.timedelta(days=1)), ("A", DAY0 - dt.timedelta(days=9))], "symbol string, date date")
    got = {r["date"]: r["price_after"] for r in A.nth_bar_after(ev, bars, 1).collect()}
    assert list(got.values()).count(11.0) == 2 and got[DAY0 - dt.timedelta(days=9)] == 10.0


@pytest.mark.parametrize("chunk_rows", [7, 50, 1000])
def test_chunked_windows_equal_plain_windows(spark, chunk_rows):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else "b", DAY0 + dt.timedelta(days=rng.randrange(40)), i, rng.random()) for i in range(500)]
    t = spark.createDataFrame(rows, "symbol string, date date, id int, price double")
    order = ("date", "id")
    plain = t.withColumn("m", W.sma("price", 6, order=order))
    c = chunked(t, 5, ["symbol"], list(order), F.col("date"), chunk_rows)
    c = drop_halo(c.withColumn("m", W.sma("price", 6, by=("symbol", "_chunk"), order=order)))
    want = {r["id"]: r["m"] for r in plain.collect()}
    got = {r["id"]: r["m"] for r in c.collect()}
    assert got.keys() == want.keys()
    assert all((got[k] is None) == (want[k] is None) and (got[k] is None or got[k] == pytest.approx(want[k])) for k in want)
    n = number_rows(t, ["symbol"], list(order), F.col("date"))
    assert {r["id"]: r["rn"] for r in n.collect()} == {r["id"]: r["rn"] for r in t.withColumn("rn", W.row_no(order=order)).collect()}
    s = running_total(t, "price", ["symbol"], list(order), F.col("date"))
    w = t.withColumn("running", F.sum("price").over(W.cumulative(order=order)))
    a, b = ({r["id"]: r["running"] for r in d.collect()} for d in (s, w))
    assert all(a[k] == pytest.approx(b[k]) for k in b)


def test_max_pain_equals_theta_form(spark):
    rng = random.Random(2)
    rows = [(DAY0, float(k), t, float(rng.randrange(1, 900))) for k in range(100, 600, 10) for t in ("CE", "PE")]
    chain = spark.createDataFrame(rows, "expiry date, strike double, opt_type string, oi double")
    want = {s: sum(max(0, s - k) * oi if t == "CE" else max(0, k - s) * oi for _, k, t, oi in rows) for _, s, _, _ in rows}
    got = {r["strike"]: r["pain"] for r in OC.strike_pain(chain).collect()}
    assert got == pytest.approx(want)
    assert OC.max_pain(chain, 250.0).first()["max_pain_strike"] == min(want, key=lambda s: (want[s], s))


def test_stable_signal_and_streak(spark):
    labels = ["Long", "Short", "Long", "Long", "Long", "Short", "Short", "Short"]
    rows = [("A", DAY0 + dt.timedelta(days=i), s) for i, s in enumerate(labels)]
    d = G.stable_signal(spark.createDataFrame(rows, "symbol string, date date, signal string"))
    assert column(d, "stable") == ["Long", "Short", "Long", "Long", "Long", "Long", "Long", "Short"]
    f = spark.createDataFrame([(DAY0 + dt.timedelta(days=i), float(v)) for i, v in enumerate([1, 2, -1, -2, -3, 0])], "date date, net double")
    assert column(streaks(f), "streak") == [1, 2, 1, 2, 3, 1]


def test_missing_averages_lean_negative(spark):
    assert set(column(G.momentum_score(series(spark, range(1, 6))), "score")) == {-1.0}
    assert column(G.rsi(series(spark, [1, 2])).withColumn("s", G.rsi_score()), "s")[0] == 1.0


def test_swing_window_is_asymmetric(spark):
    values = [5.0] * 20
    values[9] = 9.0
    d = swing_points(series(spark, values))
    assert [i for i, x in enumerate(column(d, "swing_high")) if x and values[i] == 9.0] == [9]


def test_scaling_prices_changes_no_return_based_result(spark):
    rng = random.Random(8)
    values = [100 + rng.uniform(-3, 3) for _ in range(120)]
    a = G.rsi(series(spark, values)).withColumn("r", W.pct_change("close"))
    b = G.rsi(series(spark, [v * 7 for v in values])).withColumn("r", W.pct_change("close"))
    for name in ("rsi", "r"):
        for x, y in zip(column(a, name), column(b, name)):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-6))


def test_adaptive_weights_sum_to_one(spark):
    rows = [("A", DAY0, c, ic) for c, ic in zip(B.BASE_WEIGHTS, (0.3, -0.2, None, 0.0, -0.9, 0.5))]
    w = B.adaptive_weights(spark.createDataFrame(rows, "symbol string, date date, component string, ic double"))
    assert sum(column(w, "weight", "component")) == pytest.approx(1.0, abs=1e-5)


KEYWORDS = ["ai", "aa", "rate cut", "cut", "a.b", "stimulus", "war", "tension", "gold", "oil"]


def test_keyword_counts_equal_regex(spark):
    texts = ["AI said rate cut, Rate CUT; aaaa", "a.b axb a.ba.b", "stimulustimulus war warwar", "", None, "paid attention"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for words in (KEYWORDS, KEYWORDS[:6]):
        h = T.Hits(df, words)
        for r in h.df.select("id", *[h.count(k).alias(f"k{i}") for i, k in enumerate(words)]).collect():
            text = texts[r["id"]]
            want = [None if text is None else len(re.findall(re.escape(k), text.lower())) for k in words]
            assert [r[f"k{i}"] for i in range(len(words))] == want


def test_tags_keep_rule_order_and_default(spark):
    df = spark.createDataFrame([(1, "gold and oil"), (2, "nothing")], "id int, text string")
    t = T.tag_topics(df, {"Oil": ["oil"], "Gold": ["gold"]})
    assert column(t, "tags", "id") == [["Oil", "Gold"], ["General"]]


def test_nan_and_junk_rows_at_ingest(spark, tmp_path):
    f = tmp_path / "bars.csv"
    f.write_text("symbol,date,open,high,low,close,volume\nTicker,X,X,X,X,X,X\nA,2024-01-02,1,2,0.5,NaN,3\nA,2024-01-03,1,2,0.5,1.5,3\n")
    b = readers.read_bars(spark, str(f))
    assert column(b, "close") == [None, 1.5]
    assert readers.valid_bars(b).count() == 1


def test_writes_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x", 1.0), (2, "x", 2.0)], "date int, k string, v double")
    b = spark.createDataFrame([(2, "x", 9.0), (2, "y", 3.0)], "date int, k string, v double")
    for _ in range(2):
        sinks.write_run_date(a, path)
    for _ in range(2):
        sinks.upsert_path(spark, path, b, ["date", "k"])
    rows = {(r["date"], r["k"], r["v"]) for r in spark.read.parquet(path).collect()}
    assert rows == {(1, "x", 1.0), (2, "x", 9.0), (2, "y", 3.0)}


def test_dedupe_and_calendar(spark):
    rows = [("CPI m/m", DAY0, "FEED", "high", "US", 1), ("cpi M/M", DAY0, "CURATED", "low", "US", 2), ("Speech", DAY0, "FEED", "High", "US", 3), ("Speech", DAY0, "FEED", "High", "FR", 4)]
    c = spark.createDataFrame(rows, "event string, date date, source string, impact string, country string, id int")
    assert {r["id"] for r in M.calendar_merge(c, [F.col("id")]).collect()} == {1, 3}
    assert {(r["id"], r["event_name"]) for r in M.calendar_match(c).collect()} == {(1, "US CPI"), (3, "Speech")}


def test_latest_per_key(spark):
    d = series(spark, [1, 2, 3]).unionByName(series(spark, [5, 4], "B"))
    assert {(r["symbol"], r["close"]) for r in R.latest_per_key(d, ["symbol"]).collect()} == {("A", 3.0), ("B", 4.0)}


def test_keywords_of_tags_and_scores_are_counted_in_one_reading(spark):
    rules = {"Oil": ["oil"], "Gold": ["gold"]}
    contexts = {"Gold": (["rally"], ["war"], 0.1), "General": (["gold"], ["oil"], 0.2)}
    rows = [(1, "Gold rally", 0.2), (2, None, 0.1), (3, "gold war war", 0.0), (4, "oil war", 0.5), (5, "", None)]
    df = spark.createDataFrame(rows, "id int, text string, base_score double")
    one = T.tag_and_score(df, rules, contexts)
    assert one.columns == [*df.columns, "tags", "primary_tag", "score"]
    assert one.collect() == T.context_score(T.tag_topics(df, rules), contexts).collect()
    assert one._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_texts_become_strings_in_pieces_of_bounded_bytes():
    texts = pa.array(["x" * (T.SLICE_BYTES // 4), None, "", "ä" * T.SLICE_BYTES] * 5 + [None])
    for given in (texts, texts.slice(3, 9), texts.slice(0, 0)):
        cut = list(T._slices(given))
        assert [x for c in cut for x in c.to_pylist()] == given.to_pylist()
        assert all(len(c) == 1 or sum(len((x or "").encode()) for x in c.to_pylist()) <= T.SLICE_BYTES for c in cut)
