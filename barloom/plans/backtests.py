"""Backtests, tracking and forecasts (BT, AG-12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.rolling import normalise_pm1, pct_change, range_position, row_no, sma, zscore
from barloom.operators import backtest as B
from barloom.operators.aggregate import run_summary as run_summary_op
from barloom.operators.increments import read_results, run_increment
from barloom.operators.signals import hit_rate, momentum_score, score_to_signal
from barloom.plans import views as V
from barloom.plans.registry import query
from barloom.plans.signals import hit_sql
from barloom.plans.views import O, SIG, clip_sql, corr_sql, rnd, roll, w
from barloom.plans.windows import _norm_sql, _pos_sql
from barloom.session import stored, work_dir


def scores(spark, sf):
    return momentum_score(V.px(spark, sf))


def strat_sql(src: str = "mom", by: str = "symbol", name: str = "st") -> str:
    o = f"OVER (PARTITION BY {by} ORDER BY date)"
    return f"""{name}0 AS (SELECT *, CASE WHEN score >= 0.15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS position FROM {src}),
  {name} AS (SELECT *, coalesce(close / lag(close) {o} - 1, 0) AS ret, coalesce(abs(position - lag(position) {o}) > 0, false) AS trade,
   lag(position) {o} * coalesce(close / lag(close) {o} - 1, 0) - abs(position - lag(position) {o}) * 0.001 AS strat_ret FROM {name}0)"""


def perf_sql(src: str, ret: str, by: str = "symbol", name: str = "pf", prefix: str = "") -> str:
    o = f"OVER (PARTITION BY {by} ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"""{name}0 AS (SELECT *, 100.0 * exp(sum(ln(1 + coalesce({ret}, 0))) {o}) AS e FROM {src}),
  {name}1 AS (SELECT *, e / max(e) {o} - 1 AS dd FROM {name}0),
  {name}2 AS (SELECT {by}, count(*) AS n, arg_max(e, date) AS le, min(dd) AS mdd, avg({ret}) / (stddev_samp({ret}) + 1e-10) * sqrt(252) AS sharpe,
   avg({ret}) / (stddev_samp({ret}) FILTER ({ret} < 0) + 1e-10) * sqrt(252) AS sortino, stddev_samp({ret}) * sqrt(252) * 100 AS volatility,
   CAST(count(*) FILTER ({ret} > 0) AS DOUBLE) / nullif(count(*) FILTER ({ret} <> 0), 0) * 100 AS win_rate FROM {name}1 GROUP BY {by}),
  {name} AS (SELECT {by}, round((le / 100 - 1) * 100, 3) AS {prefix}total_return, round((pow(le / 100, 252.0 / n) - 1) * 100, 3) AS {prefix}cagr, round(sharpe, 4) AS {prefix}sharpe,
   round(sortino, 4) AS {prefix}sortino, round((pow(le / 100, 252.0 / n) - 1) / abs(mdd + 1e-10), 4) AS {prefix}calmar, round(mdd * 100, 3) AS {prefix}max_dd,
   round(volatility, 3) AS {prefix}volatility, round(win_rate, 4) AS {prefix}win_rate FROM {name}2)"""


DIGITS = {"total_return": 3, "cagr": 3, "sharpe": 4, "sortino": 4, "calmar": 4, "max_dd": 3, "volatility": 3, "win_rate": 4}


def rounded(df, prefix=""):
    return df.withColumns({prefix + c: rnd(prefix + c, n) for c, n in DIGITS.items() if prefix + c in df.columns})


S0 = f"WITH {V.SCORES}"
ST = f"{S0}, {strat_sql()}"


@query("bt_1_positions", f"{ST} SELECT symbol, date, position FROM st")
def positions(spark, sf):
    return scores(spark, sf).select("symbol", "date", B.positions("score").alias("position"))


@query("bt_2_strategy_returns", f"{ST} SELECT symbol, date, position, trade, round(ret, 6) AS ret, round(strat_ret, 6) AS strat_ret FROM st")
def strategy_returns(spark, sf):
    r = B.strategy_returns(scores(spark, sf))
    return r.select("symbol", "date", "position", "trade", rnd("ret").alias("ret"), rnd("strat_ret").alias("strat_ret"))


@query("bt_2_daily_increments", f"""{ST} SELECT symbol, date, score, position, trade, round(strat_ret, 6) AS strat_ret,
  round(product(1 + coalesce(strat_ret, 0)) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS equity,
  round(max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 4) AS high FROM st""")
def daily_increments(spark, sf):
    """History, then 20 days at once, then the last day; each run reads its days and the state alone."""
    px = stored(V.px(spark, sf).select("symbol", "date", "close", F.year("date").alias("year")), "px")
    days = [r[0] for r in px.select("date").distinct().orderBy(F.desc("date")).limit(22).collect()]  # the newest dates
    cuts = [days[-1], days[1], days[0]]
    path = work_dir(spark, "increments")
    grow = {"equity": ("product", 1 + F.coalesce("strat_ret", F.lit(0.0))), "high": ("max", F.col("close"))}
    for before, last in zip([None, *cuts], cuts):
        rows = px.filter(F.col("date") <= F.lit(last)) if before is None else px.filter((F.col("date") > F.lit(before)) & (F.col("date") <= F.lit(last)))
        run_increment(rows, path, lambda d: B.strategy_returns(momentum_score(d)), 201, grow, partition="year")
    out = read_results(spark, path)
    return out.select("symbol", "date", "score", "position", "trade", rnd("strat_ret").alias("strat_ret"), rnd("equity").alias("equity"), rnd("high", 4).alias("high"))


@query("bt_3_perf_metrics", f"""{ST}, {perf_sql('st', 'strat_ret')}, tr AS (SELECT symbol, CAST(count(*) FILTER (trade) AS BIGINT) AS trades, round(avg(position) * 100, 4) AS exposure FROM st GROUP BY 1)
  SELECT * FROM pf JOIN tr USING (symbol)""")
def perf_metrics(spark, sf):
    r = B.strategy_returns(scores(spark, sf))
    t = B.trade_stats(r).withColumn("exposure", rnd("exposure", 4))
    return rounded(B.perf_metrics(r)).join(t, "symbol")


@query("bt_4_buy_hold_compare", f"""{ST}, {perf_sql('st', 'strat_ret')}, {perf_sql('st', 'ret', name='bh', prefix='bnh_')}
  SELECT symbol, sharpe, bnh_sharpe, cagr, bnh_cagr, max_dd, bnh_max_dd, sharpe > bnh_sharpe AS beat_sharpe, max_dd > bnh_max_dd AS beat_dd FROM pf JOIN bh USING (symbol)""")
def buy_hold_compare(spark, sf):
    r = B.strategy_returns(scores(spark, sf))
    j = rounded(B.perf_metrics(r)).join(rounded(B.perf_metrics(r, "ret", prefix="bnh_"), "bnh_"), "symbol")
    return j.select("symbol", "sharpe", "bnh_sharpe", "cagr", "bnh_cagr", "max_dd", "bnh_max_dd",
                    (F.col("sharpe") > F.col("bnh_sharpe")).alias("beat_sharpe"), (F.col("max_dd") > F.col("bnh_max_dd")).alias("beat_dd"))


@query("bt_5_portfolio_equal_weight", f"""{ST} SELECT date, round(avg(strat_ret), 6) AS strat_ret, round(avg(ret), 6) AS ret FROM st
  WHERE strat_ret IS NOT NULL GROUP BY 1 HAVING count(*) = 5""")
def portfolio_equal_weight(spark, sf):
    p = B.portfolio_equal_weight(B.strategy_returns(scores(spark, sf)), ["strat_ret", "ret"], 5)
    return p.withColumns({"strat_ret": rnd("strat_ret"), "ret": rnd("ret")})


YR = f"""yr0 AS (SELECT *, CAST(year(date) AS INTEGER) AS year, min(year(date)) OVER (PARTITION BY symbol) AS fy, max(year(date)) OVER (PARTITION BY symbol) AS ly FROM mom),
  yr AS (SELECT symbol, year, date, close, score FROM yr0 WHERE year >= fy + 3 AND year < ly QUALIFY count(*) OVER (PARTITION BY symbol, year) >= 20),
  {strat_sql('yr', 'symbol, year', 'ys')}"""
YRP = f"{YR}, {perf_sql('ys', 'strat_ret', 'symbol, year')}, {perf_sql('ys', 'ret', 'symbol, year', 'bh', 'bnh_')}"
_KEEP = ["cagr", "sharpe", "max_dd", "sortino", "win_rate", "bnh_cagr", "bnh_sharpe", "bnh_max_dd"]


@query("bt_6_yearly_holdout", f"{S0}, {YRP} SELECT symbol, year, {', '.join(_KEEP)} FROM pf JOIN bh USING (symbol, year)")
def yearly_holdout(spark, sf):
    y = B.yearly_holdout(scores(spark, sf))
    return rounded(rounded(y), "bnh_").select("symbol", "year", *_KEEP)


@query("bt_7_yearly_portfolio", f"""{S0}, yb AS (SELECT min(year(date)) AS fy, max(year(date)) AS ly FROM mom),
  yr AS (SELECT symbol, CAST(year(date) AS INTEGER) AS year, date, close, score FROM mom, yb WHERE year(date) >= fy + 3 AND year(date) < ly),
  {strat_sql('yr', 'symbol, year', 'ys')},
  pr AS (SELECT year, date, avg(strat_ret) AS strat_ret, avg(ret) AS ret FROM ys WHERE strat_ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 5),
  pq AS (SELECT * FROM pr QUALIFY count(*) OVER (PARTITION BY year) >= 20),
  {perf_sql('pq', 'strat_ret', 'year')}, {perf_sql('pq', 'ret', 'year', 'bh', 'bnh_')}
  SELECT year, cagr, sharpe, max_dd, bnh_cagr, bnh_sharpe, sharpe > bnh_sharpe AS beat_bnh FROM pf JOIN bh USING (year)""")
def yearly_portfolio(spark, sf):
    return rounded(rounded(B.yearly_portfolio(scores(spark, sf), 5)), "bnh_")


@query("ag_12_run_summary", f"""{S0}, {YRP} SELECT symbol, round(avg(sharpe), 3) AS avg_sharpe, CAST(count(*) AS BIGINT) AS years, CAST(count(*) FILTER (sharpe > 0) AS BIGINT) AS years_positive,
  CAST(count(*) FILTER (sharpe > bnh_sharpe) AS BIGINT) AS years_ahead, round(CAST(count(*) FILTER (sharpe > bnh_sharpe) AS DOUBLE) / count(*), 6) AS share_ahead
  FROM pf JOIN bh USING (symbol, year) GROUP BY 1""")
def run_summary(spark, sf):
    out = run_summary_op(rounded(rounded(B.yearly_holdout(scores(spark, sf))), "bnh_"))
    return out.withColumns({"avg_sharpe": rnd("avg_sharpe", 3), "share_ahead": rnd("share_ahead")})


@query("bt_8_signal_forward_stats", f"""{S0}, f AS (SELECT symbol, {SIG} AS signal, lead(close, 20) {O} / close - 1 AS f FROM mom)
  SELECT symbol, round(avg(f) FILTER (signal = 'Long'), 6) AS long_mean, CAST(count(f) FILTER (signal = 'Long') AS BIGINT) AS long_n, round(stddev_samp(f) FILTER (signal = 'Long'), 6) AS long_std,
  round(avg(f) FILTER (signal = 'Short'), 6) AS short_mean, CAST(count(f) FILTER (signal = 'Short') AS BIGINT) AS short_n, round(avg(f), 6) AS market_mean,
  round(avg(f) FILTER (signal = 'Long') - avg(f) FILTER (signal = 'Short'), 6) AS edge FROM f GROUP BY 1""")
def signal_forward_stats(spark, sf):
    s = scores(spark, sf).withColumn("signal", score_to_signal("score"))
    out = B.signal_forward_stats(s)
    return out.withColumns({c: rnd(c) for c in ("long_mean", "long_std", "short_mean", "market_mean", "edge")})


@query("bt_9_friction_backtest", f"""{S0}, p AS (SELECT symbol, date, close, CASE {SIG} WHEN 'Long' THEN 1.0 WHEN 'Short' THEN -1.0 ELSE 0.0 END AS p FROM mom),
  g AS (SELECT symbol, date, coalesce(abs(p - lag(p) {O}) > 0.5, false)::INT AS t, lag(p) {O} * (close / lag(close) {O} - 1) AS g FROM p),
  s AS (SELECT symbol, date, CAST(c AS DOUBLE) AS cost_bps, t, g - t * c / 10000.0::DOUBLE AS net FROM g, (VALUES (10.0), (18.0), (25.0)) v(c)),
  a AS (SELECT symbol, cost_bps, count(*) AS n, avg(net) AS m, stddev_samp(net) AS sd, sum(t) / greatest((max(date) - min(date)) / 365.25::DOUBLE, 1.0) AS tp FROM s GROUP BY 1, 2)
  SELECT symbol, cost_bps, round(CASE WHEN n >= 60 AND sd >= 1e-8 THEN m / sd * sqrt(252) END, 6) AS sharpe, round(tp, 6) AS trades_pa, round(tp * (cost_bps - 10.0), 4) AS extra_drag_bps FROM a""")
def friction_backtest(spark, sf):
    s = scores(spark, sf).withColumn("signal", score_to_signal("score"))
    out = B.friction_backtest(s, [10.0, 18.0, 25.0])
    return out.withColumns({"sharpe": rnd("sharpe"), "trades_pa": rnd("trades_pa"), "extra_drag_bps": rnd("extra_drag_bps", 4)})


def _cs(n=60, need=30, by="symbol"):
    over = w(n, by)
    return f"""cs AS (SELECT *, CASE WHEN count(*) {over} >= {need} THEN covar_samp(s, r) {over} / nullif(stddev_samp(s) {over} * stddev_samp(r) {over}, 0) END AS ic,
   CASE WHEN count(*) {over} >= {need} THEN avg(CASE WHEN (s > 0) = (r > 0) THEN 1.0 ELSE 0.0 END) {over} END AS hit_rate,
   CASE WHEN count(*) {over} >= {need} THEN avg(r * sign(s)) {over} / nullif(stddev_samp(r * sign(s)) {over}, 0) * sqrt(252) END AS sharpe FROM cr)"""


NORM_S = f"cz AS (SELECT symbol, date, close, {clip_sql('(close - (' + roll('avg', 'close', 20) + ')) / nullif((' + roll('stddev_samp', 'close', 20) + '), 0)', -3.0, 3.0)} AS s FROM px), cr AS (SELECT * FROM (SELECT symbol, date, s, lead(close) {O} / close - 1 AS r FROM cz) WHERE r IS NOT NULL AND s IS NOT NULL)"


def _z(spark, sf):
    return V.px(spark, sf).withColumn("score", zscore("close", 20, limit=3))


@query("bt_10_information_coefficient", f"WITH {V.PX}, {NORM_S}, {_cs()} SELECT symbol, date, round(ic, 6) AS ic FROM cs")
def information_coefficient(spark, sf):
    return B.component_stats(_z(spark, sf)).select("symbol", "date", rnd("ic").alias("ic"))


@query("bt_11_component_hit_rate_sharpe", f"WITH {V.PX}, {NORM_S}, {_cs()} SELECT symbol, date, round(hit_rate, 6) AS hit_rate, round(sharpe, 4) AS sharpe FROM cs")
def component_hit_rate_sharpe(spark, sf):
    return B.component_stats(_z(spark, sf)).select("symbol", "date", rnd("hit_rate").alias("hit_rate"), rnd("sharpe", 4).alias("sharpe"))


_COMP = {  # component -> score over the price path
    "signal": lambda: zscore("close", 20, limit=3), "analog": lambda: normalise_pm1("close"),
    "sentiment": lambda: pct_change("close", 5), "macro": lambda: range_position("close", 60) - 50.0,
    "yield": lambda: -pct_change("close", 20), "vix": lambda: -zscore("close", 60, limit=3),
}
_COMP_SQL = {
    "signal": clip_sql(f"(close - ({roll('avg', 'close', 20)})) / nullif(({roll('stddev_samp', 'close', 20)}), 0)", -3.0, 3.0),
    "analog": _norm_sql("close"), "sentiment": f"close / lag(close, 5) {O} - 1", "macro": f"{_pos_sql('close', 60)} - 50.0",
    "yield": f"-(close / lag(close, 20) {O} - 1)",
    "vix": "-(" + clip_sql(f"(close - ({roll('avg', 'close', 60)})) / nullif(({roll('stddev_samp', 'close', 60)}), 0)", -3.0, 3.0) + ")",
}
AW = f"""cw AS (SELECT symbol, date, close, {', '.join(f'{v} AS c_{k}' for k, v in _COMP_SQL.items())} FROM px),
  cl AS ({' UNION ALL '.join(f"SELECT symbol, date, close, '{k}' AS component, c_{k} AS s FROM cw" for k in _COMP)}),
  cr AS (SELECT * FROM (SELECT *, lead(close) OVER (PARTITION BY symbol, component ORDER BY date) / close - 1 AS r FROM cl) WHERE r IS NOT NULL AND s IS NOT NULL),
  {_cs(by='symbol, component')},
  rb AS (SELECT symbol, date FROM (SELECT symbol, date, row_number() {O} AS rn FROM px) WHERE (rn - 1) % 30 = 0),
  ci AS (SELECT symbol, date, component, ic, CAST({V.map_sql('component', B.BASE_WEIGHTS)} AS DOUBLE) AS base FROM cs JOIN rb USING (symbol, date)),
  cg AS (SELECT *, greatest(CASE WHEN ic > 0.10 THEN base + least(base * 0.20, 0.07) WHEN ic < -0.05 THEN base - least(base * 0.20, 0.07) ELSE base END, 0.02) AS raw FROM ci),
  aw AS (SELECT symbol, date, component, base, round(raw / sum(raw) OVER (PARTITION BY symbol, date), 6) AS weight FROM cg)"""


def _weights(spark, sf):
    p = V.px(spark, sf)
    wide = p.withColumns({f"c_{k}": f() for k, f in _COMP.items()})
    cells = F.array(*[F.struct(F.lit(k).alias("component"), F.col(f"c_{k}").alias("score")) for k in _COMP])
    long = wide.select("symbol", "date", "close", F.explode(cells).alias("_c")).select("symbol", "date", "close", "_c.*")
    ic = B.component_stats(long, by=("symbol", "component"))
    dates = p.withColumn("rn", row_no()).filter((F.col("rn") - 1) % 30 == 0).select("symbol", "date")
    return B.adaptive_weights(ic.join(dates, ["symbol", "date"], "left_semi").select("symbol", "date", "component", "ic"))


@query("bt_12_adaptive_weights", f"WITH {V.PX}, {AW} SELECT symbol, date, component, weight FROM aw")
def adaptive_weights(spark, sf):
    return _weights(spark, sf).select("symbol", "date", "component", "weight")


@query("bt_12_weight_changes", f"""WITH {V.PX}, {AW}, ow AS (SELECT *, coalesce(lag(weight) OVER (PARTITION BY symbol, component ORDER BY date), base) AS old_weight FROM aw)
  SELECT symbol, date, component, old_weight, weight FROM ow WHERE abs(weight - old_weight) > 1e-6 AND abs(weight - old_weight) / greatest(old_weight, 1e-9) > 0.10""")
def weight_changes(spark, sf):
    return B.weight_changes(_weights(spark, sf)).select("symbol", "date", "component", "old_weight", "weight")


DEC = f"""dec AS (SELECT symbol, date, CASE {SIG} WHEN 'Long' THEN 'LONG' ELSE 'SHORT' END AS bias FROM mom WHERE {SIG} <> 'Neutral'),
  lg AS (SELECT d.symbol, d.date, bias, p.close AS price_at_signal FROM dec d ASOF LEFT JOIN px p ON d.symbol = p.symbol AND d.date <= p.date WHERE year(d.date) > 1996)"""


def _log(spark, sf):
    s = scores(spark, sf).withColumn("signal", score_to_signal("score"))
    dec = s.filter(F.col("signal") != "Neutral")
    dec = dec.select("symbol", "date", F.when(F.col("signal") == "Long", "LONG").otherwise("SHORT").alias("bias"))
    old = dec.filter(F.year("date") <= 1996)
    return B.record_signals(dec, old, V.px(spark, sf))


@query("bt_13_record_signals", f"{S0}, {DEC} SELECT symbol, date, bias, round(price_at_signal, 6) AS price_at_signal, 'OPEN' AS status FROM lg")
def record_signals(spark, sf):
    return _log(spark, sf).withColumn("price_at_signal", rnd("price_at_signal"))


OUTC = f"""pb AS (SELECT symbol, date, close, row_number() {O} AS n FROM px),
  o0 AS (SELECT lg.symbol, lg.date, bias, price_at_signal, CAST(h AS INTEGER) AS horizon, b.n + h AS tn FROM lg JOIN pb b ON lg.symbol = b.symbol AND lg.date = b.date, (VALUES (10), (30), (60)) v(h)),
  o1 AS (SELECT o0.*, p.close AS po, p.date AS outcome_date, price_at_signal * 1.05 AS th, price_at_signal * 0.95 AS tl, CASE bias WHEN 'LONG' THEN price_at_signal * 0.95 ELSE price_at_signal * 1.05 END AS sl
   FROM o0 JOIN pb p ON o0.symbol = p.symbol AND o0.tn = p.n WHERE o0.date + CAST(ceil(horizon * 1.4) AS INTEGER) <= DATE '2002-01-01'),
  o2 AS (SELECT *, round(CASE bias WHEN 'LONG' THEN (po - price_at_signal) / price_at_signal * 100.0 ELSE -((po - price_at_signal) / price_at_signal * 100.0) END, 2) AS return_pct,
   CASE bias WHEN 'LONG' THEN po >= th ELSE po <= tl END AS hit_target, CASE bias WHEN 'LONG' THEN po <= sl ELSE po >= sl END AS hit_stop FROM o1),
  oc AS (SELECT *, CASE WHEN hit_target THEN 'TARGET HIT' WHEN hit_stop THEN 'STOP HIT' WHEN return_pct > 2 THEN 'WINNING' WHEN return_pct < -2 THEN 'LOSING' ELSE 'FLAT' END AS outcome_label FROM o2)"""


def _outcomes(spark, sf):
    p = F.col("price_at_signal")
    log = stored(_log(spark, sf), "signal-log").withColumns({
        "target_high": p * 1.05, "target_low": p * 0.95,
        "stop_level": F.when(F.col("bias") == "LONG", p * 0.95).otherwise(p * 1.05)})
    return log, B.signal_outcomes(log, V.px(spark, sf), as_of=F.lit("2002-01-01").cast("date"))


@query("bt_14_signal_outcomes", f"{S0}, {DEC}, {OUTC} SELECT symbol, date, horizon, outcome_date, return_pct, hit_target, hit_stop, outcome_label FROM oc")
def signal_outcomes(spark, sf):
    return _outcomes(spark, sf)[1].select("symbol", "date", "horizon", "outcome_date", "return_pct", "hit_target", "hit_stop", "outcome_label")


@query("bt_14_close_finished", f"""{S0}, {DEC}, {OUTC}, dn AS (SELECT symbol, date, count(*) AS n FROM oc GROUP BY 1, 2)
  SELECT lg.symbol, lg.date, CASE WHEN n >= 3 THEN 'CLOSED' ELSE 'OPEN' END AS status FROM lg LEFT JOIN dn ON lg.symbol = dn.symbol AND lg.date = dn.date""")
def close_finished(spark, sf):
    log, out = _outcomes(spark, sf)
    return B.close_finished(log, out).select("symbol", "date", "status")


@query("bt_15_model_health", f"""{S0}, {hit_sql('mom')}, m1 AS (SELECT * FROM mom JOIN hr USING (symbol, date)), m2 AS (SELECT * FROM m1 QUALIFY date >= max(date) OVER (PARTITION BY symbol) - 135),
  {strat_sql('m2', 'symbol', 'hs')}, e AS (SELECT *, 100.0 * exp(sum(ln(1 + coalesce(strat_ret, 0))) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) AS e FROM hs),
  d AS (SELECT *, (e / max(e) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1) * 100 AS dd FROM e),
  g AS (SELECT symbol, CASE WHEN count(*) >= 20 THEN round(CASE WHEN stddev_samp(strat_ret) = 0 THEN 0 ELSE avg(strat_ret) / stddev_samp(strat_ret) * sqrt(252) END, 3) END AS sharpe,
   round(min(dd), 2) AS max_dd, round(arg_max(dd, date), 2) AS current_dd, round(arg_max(hit_rate, date) * 100, 1) AS hit_rate FROM d GROUP BY 1)
  SELECT *, CASE WHEN sharpe < 0 OR hit_rate < 35 OR current_dd < -25 THEN 'CRITICAL' WHEN sharpe < 0.2 OR hit_rate < 45 OR current_dd < -15 THEN 'WARNING' ELSE 'HEALTHY' END AS status,
   array_to_string(list_filter([CASE WHEN sharpe < 0 THEN 'sharpe critical' WHEN sharpe < 0.2 THEN 'sharpe warning' END, CASE WHEN hit_rate < 35 THEN 'hit rate critical' WHEN hit_rate < 45 THEN 'hit rate warning' END,
   CASE WHEN current_dd < -25 THEN 'drawdown critical' WHEN current_dd < -15 THEN 'drawdown warning' END], lambda x: x IS NOT NULL), ', ') AS alerts FROM g""")
def model_health(spark, sf):
    h = B.model_health(hit_rate(scores(spark, sf)))
    return h.withColumn("alerts", F.array_join("alerts", ", "))


HEALTH = f"""{hit_sql('mom')}, m1 AS (SELECT * FROM mom JOIN hr USING (symbol, date)), m2 AS (SELECT * FROM m1 QUALIFY date >= max(date) OVER (PARTITION BY symbol) - 135),
  {strat_sql('m2', 'symbol', 'hs')}"""


@query("bt_15_health_from_outcomes", f"""{S0}, {DEC}, {OUTC}, {HEALTH}, oh AS (SELECT oc.symbol, avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0.0 END) AS hit FROM oc JOIN (SELECT symbol, max(date) AS me FROM m1 GROUP BY 1) z ON z.symbol = oc.symbol WHERE oc.date >= me - 60 GROUP BY 1),
  e AS (SELECT *, 100.0 * exp(sum(ln(1 + coalesce(strat_ret, 0))) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)) AS e FROM hs),
  d AS (SELECT *, (e / max(e) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1) * 100 AS dd FROM e),
  g AS (SELECT symbol, CASE WHEN count(*) >= 20 THEN round(CASE WHEN stddev_samp(strat_ret) = 0 THEN 0 ELSE avg(strat_ret) / stddev_samp(strat_ret) * sqrt(252) END, 3) END AS sharpe, round(arg_max(dd, date), 2) AS current_dd FROM d GROUP BY 1)
  SELECT g.symbol, round(CAST(hit * 100 AS DOUBLE), 1) AS hit_rate, CASE WHEN sharpe < 0 OR round(CAST(hit * 100 AS DOUBLE), 1) < 35 OR current_dd < -25 THEN 'CRITICAL' WHEN sharpe < 0.2 OR round(CAST(hit * 100 AS DOUBLE), 1) < 45 OR current_dd < -15 THEN 'WARNING' ELSE 'HEALTHY' END AS status
  FROM g LEFT JOIN oh ON g.symbol = oh.symbol""")
def health_from_outcomes(spark, sf):
    return B.model_health(scores(spark, sf), outcomes=_outcomes(spark, sf)[1]).select("symbol", "hit_rate", "status")


@query("bt_15_portfolio_health", f"""{S0}, {HEALTH}, dl AS (SELECT date, avg(strat_ret) AS r FROM hs GROUP BY 1 HAVING count(strat_ret) = (SELECT count(DISTINCT symbol) FROM hs)),
  e AS (SELECT *, exp(sum(ln(1 + r)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS e FROM dl), d AS (SELECT *, (e / max(e) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1) * 100 AS dd FROM e),
  g AS (SELECT CASE WHEN count(*) >= 20 THEN round(CASE WHEN stddev_samp(r) = 0 THEN 0 ELSE avg(r) / stddev_samp(r) * sqrt(252) END, 3) END AS sharpe, round(min(dd), 2) AS max_dd, round(arg_max(dd, date), 2) AS current_dd FROM d)
  SELECT *, CASE WHEN sharpe < 0 OR current_dd < -25 THEN 'CRITICAL' WHEN sharpe < 0.2 OR current_dd < -15 THEN 'WARNING' ELSE 'HEALTHY' END AS status FROM g""")
def portfolio_health(spark, sf):
    return B.portfolio_health(scores(spark, sf))


AR = f"""pr AS (SELECT symbol, date, close, close / lag(close) {O} - 1 AS ret FROM px), pl AS (SELECT *, lag(ret) {O} AS x FROM pr),
  ar AS (SELECT *, CASE WHEN count(x) {{w}} >= {{n}} THEN regr_slope(ret, x) {{w}} END AS b, CASE WHEN count(x) {{w}} >= {{n}} THEN regr_intercept(ret, x) {{w}} END AS a FROM pl)"""


def ar_sql(n):
    return AR.format(n=n, w=w(n))


_SUM = "{h} * (a / (1 - b)) + (ret - a / (1 - b)) * b * (1 - pow(b, {h})) / (1 - b)"


def _px_ret(spark, sf):
    return V.px(spark, sf).withColumn("ret", pct_change("close"))


@query("bt_16_ar_forecast", f"""WITH {V.PX}, {ar_sql(252)}, pa AS (SELECT symbol, date, close, """ + " * ".join(
    f"(1 + a / (1 - b) + (ret - a / (1 - b)) * pow(b, {k}))" for k in range(1, 31)) + """ AS p FROM ar)
  SELECT symbol, date, round(close * p, 2) AS forecast, round((p - 1) * 100, 4) AS forecast_pct, CASE WHEN p IS NULL THEN NULL WHEN p > 1 THEN 'UP' ELSE 'DOWN' END AS direction FROM pa""")
def ar_forecast(spark, sf):
    f = B.ar_forecast(_px_ret(spark, sf), 30, 252)
    return f.select("symbol", "date", rnd("forecast", 2).alias("forecast"), rnd("forecast_pct", 4).alias("forecast_pct"), "direction")


def _ar3_sql(n: int, h: int) -> str:
    """AR(3) by Cramer's rule, then h predicted returns one by one."""
    over = w(n)
    x = ["ret"] + [f"lag(ret, {k}) {O}" for k in (1, 2, 3)]
    cov = {(i, j): f"CASE WHEN count(x3) {over} >= {n} THEN covar_pop(x{i}, x{j}) {over} END" for i in range(4) for j in range(max(i, 1), 4)}
    c = lambda i, j: f"c{min(i, j)}{max(i, j)}"

    def det(cols: list[list[str]]) -> str:
        a, b, d = cols
        return (f"({a[0]} * ({b[1]} * {d[2]} - {b[2]} * {d[1]}) - {b[0]} * ({a[1]} * {d[2]} - {a[2]} * {d[1]}) + {d[0]} * ({a[1]} * {b[2]} - {a[2]} * {b[1]}))")

    columns = [[c(i, j) for i in (1, 2, 3)] for j in (1, 2, 3)]
    right = [c(0, i) for i in (1, 2, 3)]
    slopes = [f"{det([right if k == j else col for k, col in enumerate(columns)])} / {det(columns)} AS b{j + 1}" for j in range(3)]
    sql = f"""x0 AS (SELECT symbol, date, close, close / lag(close) {O} - 1 AS ret FROM px), x1 AS (SELECT *, {', '.join(f'{e} AS y{k}' for k, e in enumerate(x))} FROM x0),
  x2 AS (SELECT *, {', '.join(f'CASE WHEN y3 IS NOT NULL THEN y{k} END AS x{k}' for k in range(4))} FROM x1),
  x3 AS (SELECT *, {', '.join(f'{e} AS c{i}{j}' for (i, j), e in cov.items())}, {', '.join(f'avg(x{k}) {over} AS m{k}' for k in range(4))} FROM x2),
  x4 AS (SELECT *, {', '.join(slopes)} FROM x3), r0 AS (SELECT symbol, date, close, b1, b2, b3, m0 - b1 * m1 - b2 * m2 - b3 * m3 AS a, y0 AS u1, y1 AS u2, y2 AS u3, 1.0::DOUBLE AS p FROM x4)"""
    for k in range(1, h + 1):
        sql += f""",
  r{k} AS (SELECT symbol, date, close, b1, b2, b3, a, u0 AS u1, u1 AS u2, u2 AS u3, p * (1 + u0) AS p FROM (SELECT *, a + b1 * u1 + b2 * u2 + b3 * u3 AS u0 FROM r{k - 1}))"""
    return sql


@query("bt_16_ar_forecast_p", f"""WITH {V.PX}, {_ar3_sql(252, 5)} SELECT symbol, date, round(a, 7) AS ar_a, round(b1, 5) AS b1, round(b2, 5) AS b2, round(b3, 5) AS b3, round((p - 1) * 100, 4) AS forecast_pct,
  CASE WHEN p IS NULL THEN NULL WHEN p > 1 THEN 'UP' ELSE 'DOWN' END AS direction FROM r5""")
def ar_forecast_p(spark, sf):
    f = B.ar_forecast(_px_ret(spark, sf), 5, 252, 3)
    return f.select("symbol", "date", rnd("ar_a", 7).alias("ar_a"), *[rnd(F.col("ar_b")[k], 5).alias(f"b{k + 1}") for k in range(3)],
                    rnd("forecast_pct", 4).alias("forecast_pct"), "direction")


@query("bt_17_directional_accuracy", f"""WITH {V.PX}, {ar_sql(252)}, f AS (SELECT *, CASE WHEN count(ret) OVER n = 21 THEN sum(ret) OVER n END AS act, {_SUM.format(h=21)} AS pred FROM ar
   WINDOW n AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)),
  t AS (SELECT *, row_number() {O} AS k FROM f WHERE b IS NOT NULL AND act IS NOT NULL),
  c AS (SELECT symbol, date, CASE WHEN (pred > 0) = (act > 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correct FROM t WHERE (k - 1) % 21 = 0)
  SELECT symbol, date, correct, round(({roll('avg', 'correct', 12)}) * 100, 4) AS accuracy FROM c""")
def directional_accuracy(spark, sf):
    d = B.directional_accuracy(_px_ret(spark, sf))
    return d.select("symbol", "date", "correct", rnd("accuracy", 4).alias("accuracy"))


@query("bt_18_df_tstat", f"""WITH {V.PX}, l AS (SELECT symbol, lag(close) {O} AS l, close - lag(close) {O} AS d FROM px), g AS (SELECT symbol, regr_slope(d, l) AS slope, regr_sxx(d, l) AS sxx,
  regr_syy(d, l) AS syy, regr_sxy(d, l) AS sxy, count(*) AS n FROM l WHERE d IS NOT NULL GROUP BY 1)
  SELECT symbol, round(slope, 6) AS slope, CAST(n AS BIGINT) AS n, round(slope / sqrt((syy - slope * sxy) / (n - 2) / sxx), 4) AS tstat FROM g""")
def df_tstat(spark, sf):
    return B.df_tstat(V.px(spark, sf)).withColumns({"slope": rnd("slope"), "tstat": rnd("tstat", 4)})


@query("bt_19_forecast_consensus", f"""WITH {V.PX}, {ar_sql(252)}, c AS (SELECT symbol, date, {_SUM.format(h=30)} AS f, {roll('avg', 'ret', 60)} AS drift FROM ar)
  SELECT symbol, date, CASE WHEN f IS NULL OR drift IS NULL THEN 'N/A' WHEN (f > 0) = (drift > 0) THEN 'AGREE' ELSE 'SPLIT' END AS consensus FROM c""")
def forecast_consensus(spark, sf):
    f = B.ar_fit(_px_ret(spark, sf), 252)
    f = f.withColumns({"_f": B.ar_sum(30), "_d": sma("ret", 60)})
    return f.select("symbol", "date", B.forecast_consensus("_f", "_d").alias("consensus"))
