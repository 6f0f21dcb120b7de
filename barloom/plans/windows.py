"""Window functions over the bar history (WN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import rolling as W
from barloom.functions.scalar import clip, ladder
from barloom.operators.chunking import chunked, drop_halo, number_rows, running_total
from barloom.operators.levels import nearest_levels, nearest_levels_history, swing_points
from barloom.operators.order_stats import rank_pct_long
from barloom.operators.pairs import pair_rows
from barloom.operators.ranking import top_per_key
from barloom.operators.smoothing import with_ewm
from barloom.operators.splits import split_evenly
from barloom.plans import views as V
from barloom.plans.registry import query
from barloom.plans.views import O, clip_sql, corr_sql, rnd, roll, w

B = f"WITH {V.BARS}"


def _b(spark, sf):
    return V.bars(spark, sf).select("symbol", "date", "close")


@query("wn_1_pct_change_diff", f"""{B} SELECT symbol, date, round(close / lag(close, 5) {O} - 1, 6) AS chg5,
  round(close - lag(close, 1) {O}, 4) AS diff1 FROM bars""")
def pct_change_diff(spark, sf):
    return _b(spark, sf).select("symbol", "date", rnd(W.pct_change("close", 5)).alias("chg5"), rnd(W.diff("close"), 4).alias("diff1"))


@query("wn_2_forward_return", f"{B} SELECT symbol, date, round(lead(close, 20) {O} / close - 1, 6) AS fwd20 FROM bars")
def forward_return(spark, sf):
    return _b(spark, sf).select("symbol", "date", rnd(W.forward_return("close", 20)).alias("fwd20"))


@query("wn_3_sma", f"{B} SELECT symbol, date, " + ", ".join(f"round({roll('avg', 'close', n)}, 6) AS ma{n}" for n in (20, 60, 200)) + " FROM bars")
def sma(spark, sf):
    return _b(spark, sf).select("symbol", "date", *[rnd(W.sma("close", n)).alias(f"ma{n}") for n in (20, 60, 200)])


@query("wn_4_rolling_std_vol", f"""WITH {V.RETS} SELECT symbol, date, round({roll('stddev_samp', 'ret', 20)}, 6) AS std20,
  round({roll('var_samp', 'ret', 60)}, 6) AS var60, round({roll('stddev_samp', 'ret', 20)} * sqrt(252) * 100.0, 4) AS vol20 FROM rets""")
def rolling_std_vol(spark, sf):
    return V.returns(spark, sf).select(
        "symbol", "date", rnd(W.rolling_std("ret", 20)).alias("std20"),
        rnd(W.rolling(F.var_samp, "ret", 60)).alias("var60"), rnd(W.realised_vol("ret", 20), 4).alias("vol20"))


def _pos_sql(x, n, need=None, **kw):
    lo, hi = roll("min", x, n, need, **kw), roll("max", x, n, need, **kw)
    return f"({x} - ({lo})) / nullif(({hi}) - ({lo}), 0) * 100.0"


def _norm_sql(x, n=252, need=60, **kw):
    lo, hi = roll("min", x, n, need, **kw), roll("max", x, n, need, **kw)
    return clip_sql(f"({x} - ({lo})) / (({hi}) - ({lo}) + 1e-10) * 2.0 - 1.0", -1.0, 1.0)


@query("wn_5_range_position", f"{B} SELECT symbol, date, round({_pos_sql('close', 252)}, 6) AS pos FROM bars")
def range_position(spark, sf):
    return _b(spark, sf).select("symbol", "date", rnd(W.range_position("close", 252)).alias("pos"))


@query("wn_6_normalise_pm1", f"{B} SELECT symbol, date, round({_norm_sql('close')}, 6) AS norm FROM bars")
def normalise_pm1(spark, sf):
    return _b(spark, sf).select("symbol", "date", rnd(W.normalise_pm1("close")).alias("norm"))


@query("wn_7_zscore", f"""{B} SELECT symbol, date, round({clip_sql(f"(close - ({roll('avg', 'close', 252)})) / ({roll('stddev_samp', 'close', 252)})", -3.0, 3.0)}, 6) AS z FROM bars""")
def zscore(spark, sf):
    return _b(spark, sf).select("symbol", "date", rnd(W.zscore("close", 252, limit=3)).alias("z"))


_PAIR_SQL = V.WRET + ", pr AS (" + " UNION ALL ".join(
    f"SELECT date, '{a}' AS a, '{b}' AS b, '{a}{b}' AS pair, r{a[1]} AS x, r{b[1]} AS y FROM wret WHERE r{a[1]} IS NOT NULL" for a, b in V.PAIRS) + ")"


def _pair_returns(spark, sf):
    wide = V.wide_returns(spark, sf)
    names = {f"r{p[1]}": p for p in V.PANEL}
    return pair_rows(wide, [(f"r{a[1]}", f"r{b[1]}") for a, b in V.PAIRS], labels=names)


@query("wn_8_rolling_corr", f"WITH {_PAIR_SQL} SELECT date, a, b, round({corr_sql('x', 'y', 20, 'pair')}, 6) AS corr20 FROM pr")
def rolling_corr(spark, sf):
    p = _pair_returns(spark, sf)
    return p.select("date", "a", "b", rnd(W.rolling_corr("x", "y", 20, by=("a", "b"))).alias("corr20"))


def _beta_sql(y, x, n, by="pair"):
    over = w(n, by)
    return f"CASE WHEN count({x}) {over} >= {n} THEN covar_samp({y}, {x}) {over} / nullif(var_samp({x}) {over}, 0) END"


@query("wn_9_rolling_beta", f"WITH {_PAIR_SQL} SELECT date, a, b, " + ", ".join(
    f"round({_beta_sql('y', 'x', n)}, 6) AS beta{n}" for n in (20, 60, 120)) + " FROM pr")
def rolling_beta(spark, sf):
    p = _pair_returns(spark, sf)
    return p.select("date", "a", "b", *[rnd(W.rolling_beta("y", "x", n, by=("a", "b"))).alias(f"beta{n}") for n in (20, 60, 120)])


@query("wn_10_rolling_r2", f"WITH {_PAIR_SQL} SELECT date, a, b, round(pow({corr_sql('x', 'y', 20, 'pair')}, 2), 6) AS r2 FROM pr")
def rolling_r2(spark, sf):
    return _pair_returns(spark, sf).select("date", "a", "b", rnd(W.rolling_r2("y", "x", 20, by=("a", "b"))).alias("r2"))


@query("wn_11_rolling_product_spread", f"""WITH {_PAIR_SQL}, c AS (SELECT date, a, b,
  CASE WHEN count(x) {w(20, 'pair')} >= 20 THEN product(1 + x) {w(20, 'pair')} - product(1 + y) {w(20, 'pair')} END AS d,
  CASE WHEN count(x) {w(20, 'pair')} >= 20 THEN product(1 + x) {w(20, 'pair')} + product(1 + y) {w(20, 'pair')} END AS s FROM pr)
  SELECT date, a, b, round(d / s, 6) AS rel_spread FROM c""")
def rolling_product_spread(spark, sf):
    p = _pair_returns(spark, sf)
    x, y = (W.compounded(v, 20, by=("a", "b")) for v in ("x", "y"))
    return p.select("date", "a", "b", rnd((x - y) / (x + y + 2.0)).alias("rel_spread"))


def _ewm_sql(value: str, alpha: float, adjust: bool) -> str:
    """Exact weights of the full recursion by a self join on the row number."""
    k = f"pow({1 - alpha}, CAST(a.rn - h.rn AS DOUBLE))"
    if adjust:
        return f"sum(h.{value} * {k}) / sum({k})"
    return f"sum(h.{value} * {k} * CASE WHEN h.rn = 1 THEN 1.0 ELSE {alpha} END)"


@query("wn_12_ewm", f"""{B}, n AS (SELECT symbol, date, close, row_number() {O} AS rn FROM bars)
  SELECT a.symbol, a.date, round({_ewm_sql('close', 2 / 15, False)}, 2) AS ewm_span14, round({_ewm_sql('close', 1 / 14, True)}, 2) AS ewm_alpha14
  FROM n a JOIN n h ON a.symbol = h.symbol AND h.rn <= a.rn GROUP BY 1, 2""")
def ewm(spark, sf):
    d = with_ewm(_b(spark, sf), {"ewm_span14": "close"}, 2 / 15)
    d = with_ewm(d, {"ewm_alpha14": "close"}, 1 / 14, adjust=True)
    return d.select("symbol", "date", rnd("ewm_span14", 2).alias("ewm_span14"), rnd("ewm_alpha14", 2).alias("ewm_alpha14"))


def rank_sql(n: int, table: str = "n", x: str = "close") -> str:
    return (f"SELECT a.symbol, a.date, (count(*) FILTER (h.{x} < a.{x}) + (count(*) FILTER (h.{x} = a.{x}) + 1) / 2.0) / count(*) AS pr, count(*) AS cnt "
            f"FROM {table} a JOIN {table} h ON a.symbol = h.symbol AND h.rn BETWEEN a.rn - {n - 1} AND a.rn GROUP BY 1, 2")


@query("wn_13_rank_pct_rolling", f"""{B}, n AS (SELECT symbol, date, close, row_number() {O} AS rn FROM bars), r AS ({rank_sql(252)})
  SELECT symbol, date, round(CASE WHEN cnt >= 252 THEN CAST(pr AS DOUBLE) END, 6) AS pct FROM r""")
def rank_pct_rolling(spark, sf):
    return _b(spark, sf).select("symbol", "date", rnd(W.rank_pct_rolling("close", 252)).alias("pct"))


@query("wn_14_rank_pct_full", f"""{B}, r AS (SELECT symbol, date, rank() OVER (PARTITION BY symbol ORDER BY close) AS rk,
  count(*) OVER (PARTITION BY symbol, close) AS ties, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
  SELECT symbol, date, round(CAST(rk + (ties - 1) / 2.0 AS DOUBLE) / n, 6) AS pct FROM r""")
def rank_pct_full(spark, sf):
    return _b(spark, sf).select("symbol", "date", rnd(W.rank_pct_full("close")).alias("pct"))


@query("wn_15_pct_le_full_lt_tail", f"""{B}, n AS (SELECT symbol, date, close, row_number() {O} AS rn FROM bars),
  c AS (SELECT symbol, date, cume_dist() OVER (PARTITION BY symbol ORDER BY close) AS le FROM bars),
  t AS (SELECT a.symbol, a.date, CAST(count(*) FILTER (h.close < a.close) AS DOUBLE) / count(*) AS lt
   FROM n a JOIN n h ON a.symbol = h.symbol AND h.rn BETWEEN a.rn - 755 AND a.rn GROUP BY 1, 2)
  SELECT symbol, date, round(le, 6) AS pct_le, round(lt, 6) AS pct_lt FROM c JOIN t USING (symbol, date)""")
def pct_le_lt(spark, sf):
    return _b(spark, sf).select(
        "symbol", "date", rnd(W.pct_le_full("close")).alias("pct_le"), rnd(W.pct_lt_tail("close", 756)).alias("pct_lt"))


CUM = "OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"


@query("wn_16_cummax_drawdown", f"{B} SELECT symbol, date, round(close / max(close) {CUM} - 1, 6) AS dd FROM bars")
def cummax_drawdown(spark, sf):
    return _b(spark, sf).select("symbol", "date", rnd(W.drawdown("close")).alias("dd"))


@query("wn_17_cumprod_equity", f"""WITH {V.RETS} SELECT symbol, date, round(100.0 * exp(sum(ln(1 + coalesce(ret, 0) / 1000)) {CUM}), 4) AS equity FROM rets""")
def cumprod_equity(spark, sf):
    r = V.returns(spark, sf).withColumn("r", F.col("ret") / 1000.0)
    return r.select("symbol", "date", rnd(W.equity_curve("r"), 4).alias("equity"))


def sharpe_sql(x, n):
    return f"({roll('avg', x, n)}) / (({roll('stddev_samp', x, n)}) + 1e-10) * sqrt(252)"


@query("wn_18_rolling_sharpe", f"WITH {V.RETS} SELECT symbol, date, round({sharpe_sql('ret', 90)}, 6) AS sharpe FROM rets")
def rolling_sharpe(spark, sf):
    return V.returns(spark, sf).select("symbol", "date", rnd(W.rolling_sharpe("ret", 90)).alias("sharpe"))


@query("wn_19_streak", f"""WITH {V.FLOWS}, s AS (SELECT date, net >= 0 AS up, lag(net >= 0) OVER (ORDER BY date) AS pu FROM flows),
  i AS (SELECT date, up, sum(CASE WHEN pu IS NULL OR pu <> up THEN 1 ELSE 0 END) OVER (ORDER BY date) AS isl FROM s)
  SELECT date, CASE WHEN up THEN 'BUY' ELSE 'SELL' END AS direction, CAST(row_number() OVER (PARTITION BY isl ORDER BY date) AS INTEGER) AS streak FROM i""")
def streak(spark, sf):
    from barloom.operators.flows import streaks

    return streaks(V.flows(spark, sf)).select("date", "direction", "streak")


@query("wn_20_swing_extrema", f"""{B}, s AS (SELECT symbol, date, close, row_number() {O} AS rn, count(*) OVER (PARTITION BY symbol) AS n,
  max(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS mx,
  min(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS mn FROM bars)
  SELECT symbol, date, rn > 5 AND rn <= n - 5 AND close = mx AS swing_high, rn > 5 AND rn <= n - 5 AND close = mn AS swing_low FROM s""")
def swing_extrema(spark, sf):
    return swing_points(_b(spark, sf)).select("symbol", "date", "swing_high", "swing_low")


LEVELS_SQL = """sw AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, count(*) OVER (PARTITION BY symbol) AS n,
  max(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS mx,
  min(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS mn FROM bars),
  cur AS (SELECT symbol, arg_max(close, date) AS c FROM bars GROUP BY 1),
  lev AS (SELECT sw.symbol, max(c) AS current,
   coalesce(min(CASE WHEN rn > 5 AND rn <= n - 5 AND close = mx AND close > c THEN close END), max(CASE WHEN rn > n - 252 THEN close END)) AS nearest_resistance,
   coalesce(max(CASE WHEN rn > 5 AND rn <= n - 5 AND close = mn AND close < c THEN close END), min(CASE WHEN rn > n - 252 THEN close END)) AS nearest_support
   FROM sw JOIN cur USING (symbol) GROUP BY 1)"""


@query("wn_21_nearest_level", f"{B}, {LEVELS_SQL} SELECT * FROM lev")
def nearest_level(spark, sf):
    return nearest_levels(_b(spark, sf))


LEVELS_HISTORY_SQL = LEVELS_SQL.split(",\n  cur AS")[0] + """, lv AS (SELECT a.symbol, a.date, a.close AS current,
   coalesce(min(CASE WHEN s.close = s.mx AND s.close > a.close THEN s.close END), max(a.hi)) AS nearest_resistance,
   coalesce(max(CASE WHEN s.close = s.mn AND s.close < a.close THEN s.close END), max(a.lo)) AS nearest_support
   FROM (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING) AS hi, min(close) OVER (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING) AS lo FROM sw) a
   LEFT JOIN sw s ON s.symbol = a.symbol AND s.rn > 5 AND s.rn <= a.rn - 5 GROUP BY 1, 2, 3)"""


@query("wn_21_nearest_level_history", f"{B}, {LEVELS_HISTORY_SQL} SELECT * FROM lv")
def nearest_level_history(spark, sf):
    return nearest_levels_history(_b(spark, sf))


@query("wn_22_accum_divergence", f"""WITH {V.WRET}, a AS (SELECT date, {_pos_sql('p1', 252, by=None)} AS pos, ({roll('avg', 'r1', 10, by=None)}) * 252 AS mom10,
   ({roll('avg', 'r1', 20, by=None)}) * 252 - (-(p5 / lag(p5, 20) OVER (ORDER BY date) - 1) * 100) AS dv FROM wret),
  b AS (SELECT date, pos - lag(pos, 10) OVER (ORDER BY date) + mom10 * 10 AS ad, dv FROM a)
  SELECT date, round({roll('avg', 'ad', 20, by=None)}, 4) AS accum_distrib, round({roll('avg', 'dv', 10, by=None)}, 4) AS divergence FROM b""")
def accum_divergence(spark, sf):
    k = {"by": ()}
    a = V.wide_returns(spark, sf).select(
        "date", W.range_position("p1", 252, **k).alias("pos"), (W.sma("r1", 10, **k) * 252).alias("mom10"),
        (W.sma("r1", 20, **k) * 252 + W.pct_change("p5", 20, **k) * 100.0).alias("dv"))
    b = a.withColumn("ad", W.diff("pos", 10, **k) + F.col("mom10") * 10)
    return b.select("date", rnd(W.sma("ad", 20, **k), 4).alias("accum_distrib"), rnd(W.sma("dv", 10, **k), 4).alias("divergence"))


TREND_STEPS = [(">=", 3.0, "EXPANDING"), ("<=", -3.0, "CONTRACTING")]


@query("wn_23_lag_compare", f"""{B}, c AS (SELECT symbol, date, (close / lag(close, 10) {O} - 1) * 100 AS chg FROM bars)
  SELECT symbol, date, {V.ladder_sql('chg', TREND_STEPS, 'STABLE', 'UNKNOWN')} AS trend FROM c""")
def lag_compare(spark, sf):
    b = _b(spark, sf).withColumn("chg", W.pct_change("close", 10) * 100)
    return b.select("symbol", "date", ladder("chg", TREND_STEPS, "STABLE", "UNKNOWN").alias("trend"))


@query("wn_24_block_mean_compare", f"{B} SELECT symbol, date, round(({roll('avg', 'close', 5)}) - ({roll('avg', 'close', 5, skip=5)}), 4) AS chg FROM bars")
def block_mean_compare(spark, sf):
    return _b(spark, sf).select("symbol", "date", rnd(W.block_mean_change("close", 5, 5), 4).alias("chg"))


@query("wn_25_trend_slope", f"""{B}, n AS (SELECT symbol, date, close, CAST(row_number() {O} AS DOUBLE) AS rn FROM bars)
  SELECT symbol, date, round(CASE WHEN count(close) {w(5)} >= 5 THEN regr_slope(close, rn) {w(5)} END, 4) AS slope FROM n""")
def trend_slope(spark, sf):
    n = _b(spark, sf).withColumn("rn", W.row_no())
    return n.select("symbol", "date", rnd(W.trend_slope("close", 5), 4).alias("slope"))


@query("wn_26_first_per_key", f"""{B} SELECT symbol, date, high, CAST(rn AS INTEGER) AS rn FROM
  (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY high DESC, date) AS rn FROM bars) WHERE rn <= 3""")
def first_per_key(spark, sf):
    b = V.bars(spark, sf).select("symbol", "date", "high")
    return top_per_key(b, ["symbol"], [F.col("high").desc(), F.col("date")], 3)


_LBL = "CASE WHEN close > 250000 THEN 'HIGH' ELSE 'LOW' END"


@query("wn_27_prev_label_changed", f"""{B}, l AS (SELECT symbol, date, {_LBL} AS label FROM bars)
  SELECT symbol, date, label, lag(label) {O} AS prev_label, coalesce(lag(label) {O} <> label, false) AS changed FROM l""")
def prev_label_changed(spark, sf):
    l = _b(spark, sf).select("symbol", "date", F.when(F.col("close") > 250000, "HIGH").otherwise("LOW").alias("label"))
    prev = W.lag("label")
    return l.withColumns({"prev_label": prev, "changed": F.coalesce(prev != F.col("label"), F.lit(False))})


@query("wn_28_surprise_index", f"""WITH {V.SERIES_M}, s AS (SELECT series_id AS symbol, date, value - ({roll('avg', 'value', 12, by='series_id')}) AS sp FROM series_m)
  SELECT symbol AS series_id, date, round({clip_sql(f"(sp - ({roll('avg', 'sp', 12)})) / nullif(({roll('stddev_samp', 'sp', 12)}), 0)", -3.0, 3.0)}, 6) AS surprise FROM s""")
def surprise_index(spark, sf):
    from barloom.operators.regimes import surprise_index as si

    return si(V.series_m(spark, sf), by="series_id").select("series_id", "date", rnd("surprise").alias("surprise"))


# -------------------------------------------------------- series too long for one task: ticks

T_OVER = "OVER (PARTITION BY symbol ORDER BY ts, id"


def _even_ticks(spark, sf):
    return split_evenly(V.ticks(spark, sf), ["symbol"], "ts", F.col("id"))


@query("wn_3_sma_ticks", f"""WITH {V.TICKS} SELECT symbol, id, round(CASE WHEN count(price) {T_OVER} ROWS 19 PRECEDING) >= 20
  THEN avg(price) {T_OVER} ROWS 19 PRECEDING) END, 6) AS ma20 FROM ticks""")
def sma_ticks(spark, sf):
    c = chunked(_even_ticks(spark, sf), 19, ["symbol"], ["ts", "id"], F.col("_split"))
    ma = W.sma("price", 20, by=("symbol", "_chunk"), order=("ts", "id"))
    return drop_halo(c.withColumn("ma20", ma)).select("symbol", "id", rnd("ma20").alias("ma20"))


@query("wn_26_row_number_ticks", f"WITH {V.TICKS} SELECT symbol, id, CAST(row_number() {T_OVER}) AS BIGINT) AS rn FROM ticks")
def row_number_ticks(spark, sf):
    t = number_rows(_even_ticks(spark, sf), ["symbol"], ["ts", "id"], F.col("_split"))
    return t.select("symbol", "id", "rn")


@query("wn_17_running_total_ticks", f"""WITH {V.TICKS} SELECT symbol, id, round(sum(price) {T_OVER} ROWS UNBOUNDED PRECEDING), 2) AS running FROM ticks""")
def running_total_ticks(spark, sf):
    t = running_total(_even_ticks(spark, sf), "price", ["symbol"], ["ts", "id"], F.col("_split"))
    return t.select("symbol", "id", rnd("running", 2).alias("running"))


# Rows of the long frame.
FRAME = 5000


@query("wn_13_rank_long_ticks", f"""WITH {V.TICKS}, r AS (SELECT *, row_number() {T_OVER}) AS rn FROM ticks),
  c AS (SELECT a.symbol, a.id, count(*) AS n, count(*) FILTER (b.price < a.price) AS lt, count(*) FILTER (b.price = a.price) AS eq
   FROM r a JOIN r b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - {FRAME - 1} AND a.rn GROUP BY 1, 2)
  SELECT symbol, id, round(CASE WHEN n >= 50 THEN (lt + (eq + 1) / 2.0::DOUBLE) / n END, 8) AS rank_pct, round(lt / n, 8) AS pct_lt, round((lt + eq) / n, 8) AS pct_le FROM c""")
def rank_long_ticks(spark, sf):
    d = rank_pct_long(_even_ticks(spark, sf), "price", FRAME, ["symbol"], ["ts", "id"], F.col("_split"), min_periods=50)
    return d.select("symbol", "id", *[rnd(c, 8).alias(c) for c in ("rank_pct", "pct_lt", "pct_le")])
