"""Regimes (RG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.rolling import diff, lag, pct_change, rolling_beta, rolling_corr, rolling_r2, sma
from barloom.operators import regimes as R
from barloom.operators.align import asof_join, upsample_ffill
from barloom.operators.pairs import pair_rows
from barloom.plans import views as V
from barloom.plans.registry import query
from barloom.plans.signals import YOY
from barloom.plans.views import O, clip_sql, corr_sql, ladder_sql, map_sql, rnd, roll, w
from barloom.plans.windows import _PAIR_SQL, _pair_returns, _pos_sql
from barloom.sources.readers import table

N = {"by": None}
VIX = "p5 / 12500.0"


def _panel(spark, sf):
    return V.wide_returns(spark, sf).withColumn("vix", F.col("p5") / 12500.0)


PANEL = V.WRET + f", pn AS (SELECT *, {VIX} AS vix FROM wret)"


def _r(df, *keep, **digits):
    return df.select(*keep, *[rnd(c, n).alias(c) for c, n in digits.items()])


@query("rg_1_vix_trend_regime", f"""WITH {PANEL}, m AS (SELECT date, vix, p2, {roll('avg', 'p2', 200, **N)} AS ma FROM pn)
  SELECT date, CASE WHEN vix > 30 THEN 'Crisis' WHEN vix > 20 AND NOT p2 > ma THEN 'Bear Market' WHEN vix <= 20 AND p2 > ma THEN 'Bull Market' ELSE 'Sideways' END AS regime
  FROM m WHERE ma IS NOT NULL""")
def vix_trend_regime(spark, sf):
    return R.vix_trend_regime(_panel(spark, sf), "vix", "p2").select("date", "regime")


@query("rg_2_vol_regime", f"WITH {PANEL} SELECT date, CAST({ladder_sql('vix', R.VOL_REGIME_STEPS, 4)} AS INTEGER) AS vol_regime FROM pn")
def vol_regime(spark, sf):
    return _panel(spark, sf).select("date", R.vol_regime("vix").alias("vol_regime"))


@query("rg_3_vol_risk_premium", f"""WITH {PANEL}, n AS (SELECT date, vix, row_number() OVER (ORDER BY date) AS rn, vix - ({roll('stddev_samp', 'r2', 20, **N)}) * sqrt(252) * 100 AS vrp FROM pn),
  k AS (SELECT a.date, CAST(count(*) FILTER (h.vix < a.vix) + (count(*) FILTER (h.vix = a.vix) + 1) / 2.0 AS DOUBLE) / count(*) * 100 AS pr, count(*) AS c FROM n a JOIN n h ON h.rn BETWEEN a.rn - 251 AND a.rn GROUP BY 1)
  SELECT date, round(vrp, 4) AS vrp, round(CASE WHEN c >= 252 THEN pr END, 4) AS vix_pct_rank FROM n JOIN k USING (date)""")
def vol_risk_premium(spark, sf):
    return _r(R.vol_risk_premium(_panel(spark, sf), "vix", "r2"), "date", vrp=4, vix_pct_rank=4)


def _yoy(spark, sf):
    return V.macro(spark, sf).withColumn("cpi_yoy", pct_change("cpi_index", 12, by=()) * 100.0)


QUAD = "CASE WHEN cpi_yoy IS NULL OR growth IS NULL THEN NULL WHEN NOT cpi_yoy > 3 AND growth > 0 THEN 'Goldilocks' WHEN cpi_yoy > 3 AND growth > 0 THEN 'Overheating' WHEN cpi_yoy > 3 THEN 'Stagflation' ELSE 'Recession/Slowdown' END"


@query("rg_4_macro_quadrant", f"WITH {YOY} SELECT date, {QUAD} AS regime FROM yoy")
def macro_quadrant(spark, sf):
    return _yoy(spark, sf).select("date", R.macro_quadrant("cpi_yoy", "growth").alias("regime"))


@query("rg_5_regime_performance", f"""WITH {V.BARS}, {YOY}, q AS (SELECT date AS month, {QUAD} AS regime FROM yoy WHERE cpi_yoy IS NOT NULL),
  mc AS (SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(close, date) AS c FROM bars GROUP BY 1, 2),
  mr AS (SELECT symbol, month, (c / lag(c) OVER (PARTITION BY symbol ORDER BY month) - 1) * 100 AS ret FROM mc)
  SELECT regime, {', '.join(f"round(avg(ret) FILTER (symbol = '{s}'), 4) AS {p}" for s, p in V.SYMBOLS.items())} FROM mr JOIN q USING (month) GROUP BY 1""")
def regime_performance(spark, sf):
    b = V.bars(spark, sf).groupBy("symbol", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("c"))
    ret = b.withColumn("ret", pct_change("c", order="month") * 100.0)
    q = _yoy(spark, sf).na.drop(subset=["cpi_yoy"]).select(F.col("date").alias("month"), R.macro_quadrant("cpi_yoy", "growth").alias("regime"))
    out = R.regime_performance(ret, q, list(V.SYMBOLS))
    return out.select("regime", *[rnd(f"`{s}`", 4).alias(p) for s, p in V.SYMBOLS.items()])


def _si(x):
    return f"si_{x} AS (SELECT date, {x} - ({roll('avg', x, 12, **N)}) AS sp FROM macro), sz_{x} AS (SELECT date, {clip_sql(f'''(sp - ({roll('avg', 'sp', 12, **N)})) / nullif(({roll('stddev_samp', 'sp', 12, **N)}), 0)''', -3.0, 3.0)} AS z_{x} FROM si_{x})"


ESI = V.MACRO + ", " + ", ".join(_si(x) for x in ("policy", "growth", "y10", "cpi_index")) + f""",
  es0 AS (SELECT date, z_policy * 0.35 + z_growth * 0.30 - z_y10 * 0.20 + z_cpi_index * 0.15 AS esi FROM sz_policy JOIN sz_growth USING (date) JOIN sz_y10 USING (date) JOIN sz_cpi_index USING (date)),
  es AS (SELECT date, esi, {roll('avg', 'esi', 3, **N)} AS esi_smooth FROM es0 WHERE esi IS NOT NULL)"""


def _esi(spark, sf):
    return R.esi_composite(V.macro(spark, sf), "policy", "growth", "y10", "cpi_index")


@query("rg_6_esi_composite", f"WITH {ESI} SELECT date, round(esi, 6) AS esi, round(esi_smooth, 6) AS esi_smooth FROM es")
def esi_composite(spark, sf):
    return _r(_esi(spark, sf), "date", esi=6, esi_smooth=6)


_IND = {"cpi_yoy": "cpi_yoy", "gdp": "growth", "unemployment": "y10", "policy_rate": "policy", "real_rate": "policy - cpi_yoy", "curve": "y10 - y2", "payrolls": "cpi_index"}


@query("rg_7_scorecard", f"WITH {YOY}, v AS (SELECT date, {', '.join(f'{e} AS i_{k}' for k, e in _IND.items())} FROM yoy), l AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS indicator, arg_max(i_{k}, date) FILTER (i_{k} IS NOT NULL) AS value FROM v" for k in _IND) + ") SELECT indicator, round(value, 6) AS value, CASE " + " ".join(
    f"WHEN indicator = '{k}' THEN {ladder_sql('value', *R.SCORECARD[k])}" for k in _IND) + " END AS signal FROM l")
def scorecard(spark, sf):
    y = _yoy(spark, sf)
    v = y.select("date", "cpi_yoy", F.col("growth").alias("gdp"), F.col("y10").alias("unemployment"), F.col("policy").alias("policy_rate"),
                 (F.col("policy") - F.col("cpi_yoy")).alias("real_rate"), (F.col("y10") - F.col("y2")).alias("curve"), F.col("cpi_index").alias("payrolls"))
    return _r(R.scorecard(v, list(_IND)), "indicator", "signal", value=6)


_M1, _M2 = (f"({roll('avg', p, 20, **N)}) / ({roll('avg', p, 60, **N)}) * 100" for p in ("p1", "p2"))


@query("rg_8_risk_appetite", f"""WITH {PANEL}, m AS (SELECT *, {_M1} AS m1, {_M2} AS m2 FROM pn),
  q AS (SELECT date, {', '.join(f"{_pos_sql(c, 252, **N)} AS q_{c}" for c in ('vix', 'p3', 'p4', 'm1', 'm2'))} FROM m)
  SELECT date, round((100 - q_vix + q_m1 + q_m2 + 100 - q_p3) / 4, 4) AS risk_appetite, round((100 - q_p4) * 0.4 + (100 - q_p3) * 0.3 + q_m1 * 0.3, 4) AS flow_proxy FROM q""")
def risk_appetite(spark, sf):
    d = R.risk_appetite(_panel(spark, sf), "vix", "p1", "p2", "p3", "p4", "p3")
    return _r(d, "date", risk_appetite=4, flow_proxy=4)


def _z(x, n):
    return clip_sql(f"({x} - ({roll('avg', x, n, **N)})) / nullif(({roll('stddev_samp', x, n, **N)}), 0)", -3.0, 3.0)


def _gm(x, k):
    return clip_sql(f"({roll('avg', x, 20, **N)}) * 252 * {k}", -3.0, 3.0)


@query("rg_9_geo_risk", f"""WITH {PANEL}, g AS (SELECT date, ({_z('vix', 100)}) * 0.35 + ({_gm('r2', -2)}) * 0.30 + ({_gm('r3', 2)}) * 0.20 + ({_gm('r4', 3)}) * 0.15 AS g FROM pn),
  s AS (SELECT date, {roll('avg', 'g', 10, **N)} AS geo_risk FROM g)
  SELECT date, round(geo_risk, 6) AS geo_risk, geo_risk > ({roll('avg', 'geo_risk', 100, **N)}) + 2 * ({roll('stddev_samp', 'geo_risk', 100, **N)}) AS black_swan FROM s""")
def geo_risk(spark, sf):
    return _r(R.geo_risk(_panel(spark, sf), "vix", "r2", "r3", "r4", n=100), "date", "black_swan", geo_risk=6)


@query("rg_10_sentiment_proxy", f"""WITH {PANEL}, z AS (SELECT date, -({_z('vix', 100)}) AS z FROM pn), p AS (SELECT date, {_pos_sql('z', 100, **N)} / 100 AS p FROM z)
  SELECT date, round({roll('avg', 'p', 20, **N)}, 6) AS sentiment_proxy FROM p""")
def sentiment_proxy(spark, sf):
    return _r(R.sentiment_proxy(_panel(spark, sf), "vix", n=100), "date", sentiment_proxy=6)


@query("rg_11_seasonality", f"""WITH {V.RETS} SELECT CAST(month(date) AS INTEGER) AS month, {', '.join(f"round(avg(ret) FILTER (symbol = '{s}'), 6) AS {p}" for s, p in V.SYMBOLS.items())} FROM rets GROUP BY 1""")
def seasonality(spark, sf):
    out = V.returns(spark, sf).groupBy(F.month("date").alias("month")).pivot("symbol", list(V.SYMBOLS)).agg(F.avg("ret"))
    return out.select("month", *[rnd(f"`{s}`").alias(p) for s, p in V.SYMBOLS.items()])


@query("rg_12_corr_shift", f"""WITH {_PAIR_SQL}, c AS (SELECT date, a, b, {corr_sql('x', 'y', 20, 'pair')} AS corr20, {corr_sql('x', 'y', 60, 'pair')} AS corr60 FROM pr)
  SELECT date, a, b, round(corr20, 6) AS corr20, round(corr60, 6) AS corr60, CASE WHEN abs(corr20 - corr60) >= 0.30 THEN 'SHIFT' WHEN corr60 IS NOT NULL THEN 'STABLE' END AS shift FROM c""")
def corr_shift(spark, sf):
    return _r(R.corr_shift(_pair_returns(spark, sf)), "date", "a", "b", "shift", corr20=6, corr60=6)


# The key pairs, on the columns of the return panel.
KEY_PAIRS = {"Gold_SP500": ("r3", "r2"), "NIFTY_SP500": ("r1", "r2"), "Gold_Silver": ("r3", "r4"), "Crude_NIFTY": ("r5", "r1")}
KEYC = V.WRET + ", kc AS (" + " UNION ALL ".join(
    f"SELECT date, '{k}' AS pair, {corr_sql(x, y, 20, by=None)} AS corr FROM wret WHERE r1 IS NOT NULL" for k, (x, y) in KEY_PAIRS.items()) + ")"


def _key_corr(spark, sf):
    """20-row correlation of each key pair, one series per pair."""
    wide = V.wide_returns(spark, sf)
    cells = [F.struct(F.lit(k).alias("pair"), F.col(x).alias("x"), F.col(y).alias("y")) for k, (x, y) in KEY_PAIRS.items()]
    p = wide.select("date", F.explode(F.array(*cells)).alias("_p")).select("date", "_p.*").na.drop()
    return p.select("date", "pair", rolling_corr("x", "y", 20, by="pair").alias("corr"))


@query("rg_13_corr_regime", f"""WITH {KEYC}, p AS (SELECT date, {', '.join(f"max(corr) FILTER (pair = '{k}') AS {k}" for k in KEY_PAIRS)} FROM kc GROUP BY 1)
  SELECT date, CASE WHEN coalesce(Gold_SP500, 0) > 0.2 THEN 'RISK_OFF' WHEN coalesce(NIFTY_SP500, 0.5) < 0.4 THEN 'DECOUPLING' WHEN coalesce(NIFTY_SP500, 0.5) > 0.7 AND coalesce(Gold_SP500, 0) < 0 THEN 'RISK_ON' ELSE 'NORMAL' END AS regime FROM p""")
def corr_regime(spark, sf):
    k = _key_corr(spark, sf)
    p = k.groupBy("date").agg(*[F.max(F.when(F.col("pair") == n, F.col("corr"))).alias(n) for n in KEY_PAIRS])
    return p.select("date", R.corr_regime("Gold_SP500", "NIFTY_SP500").alias("regime"))


@query("rg_13_reliability", f"WITH {KEYC} SELECT date, pair, CASE WHEN corr IS NOT NULL THEN CASE " + " ".join(
    f"WHEN pair = '{k}' THEN {ladder_sql('corr', *v)}" for k, v in R.RELIABILITY.items()) + " ELSE 'FULL' END END AS reliability FROM kc")
def reliability(spark, sf):
    return _key_corr(spark, sf).select("date", "pair", R.reliability("pair", "corr").alias("reliability"))


@query("rg_14_corr_episodes", f"""WITH {KEYC}, s AS (SELECT *, arg_max(corr, date) OVER (PARTITION BY pair) AS cur, row_number() OVER (PARTITION BY pair ORDER BY date DESC) AS bk FROM kc WHERE corr IS NOT NULL),
  i AS (SELECT pair, date, corr, abs(corr - cur) <= 0.15 AS inb FROM s WHERE bk > 30),
  r AS (SELECT *, sum(CASE WHEN inb AND NOT coalesce(pi, false) THEN 1 ELSE 0 END) OVER (PARTITION BY pair ORDER BY date) AS run FROM (SELECT *, lag(inb) OVER (PARTITION BY pair ORDER BY date) AS pi FROM i)),
  g AS (SELECT pair, run, min(date) AS start_date, min(date) FILTER (NOT inb) AS end_date, avg(corr) FILTER (inb) AS avg_corr FROM r WHERE run > 0 GROUP BY 1, 2)
  SELECT pair, start_date, end_date, CAST(end_date - start_date AS INTEGER) AS duration, round(avg_corr, 6) AS avg_corr FROM g WHERE end_date - start_date >= 10
  QUALIFY row_number() OVER (PARTITION BY pair ORDER BY year(start_date) DESC, end_date - start_date DESC, start_date) <= 5""")
def corr_episodes(spark, sf):
    e = R.corr_episodes(_key_corr(spark, sf), by=("pair",))
    return _r(e, "pair", "start_date", "end_date", "duration", avg_corr=6)


def _beta(y, x, n, by):
    return f"CASE WHEN count({x}) {w(n, by)} >= {n} THEN covar_samp({y}, {x}) {w(n, by)} / nullif(var_samp({x}) {w(n, by)}, 0) END"


# SP return against the change of a yield-like series (y = p5 / 100000)
BETA = V.WIN + f""", yb0 AS (SELECT date, p5 / 100000 AS y, p5 / 100000 - lag(p5) OVER (ORDER BY date) / 100000 AS dy, (p2 / lag(p2) OVER (ORDER BY date) - 1) * 100 AS r FROM win),
  yb AS (SELECT date, {_beta('r', 'dy', 60, None)} / 100 AS beta, y - lag(y, 10) OVER (ORDER BY date) AS c10, y - lag(y, 30) OVER (ORDER BY date) AS c30 FROM yb0),
  yc AS (SELECT date, beta, {ladder_sql('beta', R.BETA_STEPS, 'LOW_SENSITIVITY')} AS beta_regime,
   CASE WHEN c30 IS NULL THEN 'UNKNOWN' WHEN c10 >= 0.1 THEN 'RISING' WHEN c10 <= -0.1 THEN 'FALLING' WHEN c30 > 0.05 THEN 'RISING' WHEN c30 < -0.05 THEN 'FALLING' ELSE 'FLAT' END AS yield_direction FROM yb)"""


def _betas(spark, sf):
    p = V.wide_inner(spark, sf).withColumns({"y": F.col("p5") / 100000, "r": pct_change("p2", by=()) * 100})
    p = p.withColumn("dy", diff("y", by=()))
    p = p.withColumn("beta", rolling_beta("r", "dy", 60, by=()) / 100)
    return R.yield_direction(p, "y").withColumn("beta_regime", R.beta_regime("beta"))


@query("rg_15_beta_regime", f"WITH {BETA} SELECT date, round(beta, 6) AS beta, beta_regime, yield_direction, CAST({map_sql('concat_ws(chr(47), beta_regime, yield_direction)', R.BETA_ADJUST, 0.0)} AS DOUBLE) AS adjustment FROM yc")
def beta_regime(spark, sf):
    d = _betas(spark, sf).withColumn("adjustment", R.beta_adjustment())
    return _r(d, "date", "beta_regime", "yield_direction", "adjustment", beta=6)


BCTX = f"""bt0 AS (SELECT date, a, b, pair, {_beta('y', 'x', 60, 'pair')} * 10 AS beta FROM pr), bt1 AS (SELECT *, {ladder_sql('beta', R.BETA_STEPS, 'LOW_SENSITIVITY')} AS reg FROM bt0 WHERE beta IS NOT NULL),
  bt2 AS (SELECT *, arg_max(beta, date) OVER (PARTITION BY pair) AS cur, arg_max(reg, date) OVER (PARTITION BY pair) AS creg FROM bt1),
  bt3 AS (SELECT *, row_number() OVER (PARTITION BY pair, reg ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY pair, reg) AS n FROM bt2),
  bc AS (SELECT a, b, max(cur) AS beta, max(creg) AS beta_regime, avg(CASE WHEN beta <= cur THEN 1.0 ELSE 0.0 END) * 100 AS pct_rank, CAST(count(*) FILTER (reg = creg) AS BIGINT) AS total_days,
   max(date) FILTER (reg = creg AND (k > 30 OR n <= 30)) AS recent_date FROM bt3 GROUP BY 1, 2)"""


def _ctx(spark, sf):
    p = _pair_returns(spark, sf).withColumn("beta", rolling_beta("y", "x", 60, by=("a", "b")) * 10)
    return R.beta_context(p)


@query("rg_16_beta_context", f"WITH {_PAIR_SQL}, {BCTX} SELECT a, b, round(beta, 6) AS beta, beta_regime, round(pct_rank, 6) AS pct_rank, total_days, recent_date FROM bc")
def beta_context(spark, sf):
    return _r(_ctx(spark, sf), "a", "b", "beta_regime", "total_days", "recent_date", beta=6, pct_rank=6)


@query("rg_16_beta_scenarios", f"WITH {_PAIR_SQL}, {BCTX} SELECT a, b, CAST(m AS INTEGER) AS move_bp, round(beta * m / 100.0::DOUBLE, 6) AS impact_pct FROM bc, (VALUES (10), (25), (50)) v(m)")
def beta_scenarios(spark, sf):
    return _r(R.beta_scenarios(_ctx(spark, sf)), "a", "b", "move_bp", impact_pct=6)


@query("rg_17_equal_weight_index", f"WITH {V.WIN} SELECT date, round(({' + '.join(f'100.0 * {p} / first_value({p}) OVER (ORDER BY date)' for p in V.PANEL)}) / 5, 6) AS index FROM win")
def equal_weight_index(spark, sf):
    return _r(R.equal_weight_index(V.bars(spark, sf), 5), "date", index=6)


@query("rg_18_breadth_regime", f"""WITH {_PAIR_SQL}, c AS (SELECT date, a, b, pair, {corr_sql('x', 'y', 20, 'pair')} AS corr FROM pr), q AS (SELECT *, corr * corr AS r2, corr * corr - lag(corr * corr, 4) OVER (PARTITION BY pair ORDER BY date) AS d FROM c),
  g AS (SELECT *, CASE WHEN corr IS NULL THEN NULL WHEN corr < 0.3 THEN 'EXTREME_POLARIZATION' WHEN corr >= 0.6 AND r2 < 0.5 THEN 'HEALTHY_BREADTH' ELSE 'MILD_POLARIZATION' END AS regime FROM q)
  SELECT date, a, b, regime, {ladder_sql('r2', [('>=', 0.6, 'NARROW'), ('<=', 0.4, 'BROAD')], 'MODERATE')} AS concentration, {map_sql('regime', R.BREADTH_ADJUST)} AS adjustment,
  CASE WHEN d > 0 THEN 'increasing' WHEN d IS NOT NULL THEN 'decreasing' END AS r2_trend FROM g""")
def breadth_regime(spark, sf):
    p = _pair_returns(spark, sf).withColumn("corr", rolling_corr("x", "y", 20, by=("a", "b")))
    p = p.withColumn("r2", F.col("corr") * F.col("corr"))
    regime, conc, adj = R.breadth_regime()
    d = diff("r2", 4, by=("a", "b"))
    return p.select("date", "a", "b", regime.alias("regime"), conc.alias("concentration"), adj.alias("adjustment"),
                    F.when(d > 0, "increasing").when(d.isNotNull(), "decreasing").alias("r2_trend"))


# price of one series, weekly inventory deviations carried to days
INV = V.BARS + ", " + V.POSITIONS + f""", iv AS (SELECT date, oi - ({roll('avg', 'oi', 52, **N)}) AS dev FROM positions WHERE contract = 'R'),
  pi AS (SELECT b.date, b.close, iv.dev FROM (SELECT * FROM bars WHERE symbol = '5-LOW') b ASOF LEFT JOIN (SELECT * FROM iv WHERE dev IS NOT NULL) iv ON b.date >= iv.date),
  fv AS (SELECT date, close, coalesce({roll('avg', 'close', 504, **N)}, {roll('avg', 'close', 90, **N)}) - coalesce(dev * 100, 0) / 50000.0 * 5.0 AS fair_value FROM pi),
  pm AS (SELECT date, fair_value, CASE WHEN fair_value > 0 THEN (close - fair_value) / fair_value * 100 WHEN fair_value IS NOT NULL THEN 0.0 END AS premium_pct FROM fv)"""


def _premium(spark, sf):
    inv = V.positions(spark, sf).filter("contract = 'R'").select("date", (F.col("oi") - sma("oi", 52, by=())).alias("dev")).na.drop()
    b = V.bars(spark, sf).filter("symbol = '5-LOW'").select("date", "close")
    j = asof_join(b, inv, ["dev"], by=()).withColumn("dev", F.col("dev") * 100)
    return R.fair_value_inventory(j, "close", "dev")


@query("rg_19_fair_value_ma_inv", f"WITH {INV} SELECT date, round(fair_value, 6) AS fair_value, round(premium_pct, 4) AS premium_pct FROM pm")
def fair_value_ma_inv(spark, sf):
    return _r(_premium(spark, sf), "date", fair_value=6, premium_pct=4)


RY = V.BARS + ", " + V.MACRO + f""", ry AS (SELECT b.symbol, b.date, b.close, m.rv FROM bars b ASOF LEFT JOIN (SELECT date, y10 - policy AS rv FROM macro) m ON b.date >= m.date),
  fy AS (SELECT *, ({roll('avg', 'close', 126)}) * (1 - rv * 0.05) AS fair_value FROM ry), py AS (SELECT *, (close - fair_value) / fair_value * 100 AS premium_pct FROM fy)"""


def _ry(spark, sf):
    m = V.macro(spark, sf).select("date", (F.col("y10") - F.col("policy")).alias("rv"))
    b = V.bars(spark, sf).select("symbol", "date", "close")
    j = b.join(upsample_ffill(m, by=()), "date", "left")
    j = j.withColumn("_l", m.agg(F.max(F.struct("date", "rv"))).scalar())
    j = j.withColumn("rv", F.when(F.col("date") >= F.col("_l.date"), F.col("_l.rv")).otherwise(F.col("rv"))).drop("_l")
    return R.fair_value_real_yield(j, "close", "rv", by=("symbol",))


@query("rg_20_fair_value_real_yield", f"WITH {RY} SELECT symbol, date, round(fair_value, 4) AS fair_value, round(premium_pct, 4) AS premium_pct FROM py")
def fair_value_real_yield(spark, sf):
    return _r(_ry(spark, sf), "symbol", "date", fair_value=4, premium_pct=4)


@query("rg_21_premium_class_trend_alert", f"""WITH {RY}, q AS (SELECT symbol, date, premium_pct, {ladder_sql('premium_pct', R.PREMIUM_STEPS, 'DISCOUNT')} AS c, premium_pct - lag(premium_pct, 10) {O} AS d FROM py WHERE premium_pct IS NOT NULL),
  l AS (SELECT *, lag(c) {O} AS p FROM q) SELECT symbol, date, c AS premium_class, {ladder_sql('d', R.PREMIUM_TREND, 'STABLE', 'UNKNOWN')} AS trend,
  CASE WHEN c = 'EXTREME_PREMIUM' AND p <> 'EXTREME_PREMIUM' THEN 'EXTREME' WHEN p IN ('LOW_PREMIUM', 'DISCOUNT', 'MODERATE_PREMIUM') AND c = 'HIGH_PREMIUM' THEN 'ESCALATING'
  WHEN p IN ('HIGH_PREMIUM', 'EXTREME_PREMIUM') AND c = 'MODERATE_PREMIUM' THEN 'DEESCALATING' ELSE 'NONE' END AS alert FROM l""")
def premium_class(spark, sf):
    return R.premium_class(_ry(spark, sf), by=("symbol",)).select("symbol", "date", "premium_class", "trend", "alert")


def _us(c="cpi", g="gdp", p="prev_gdp"):
    return (f"CASE WHEN {c} IS NULL OR {g} IS NULL THEN 'UNKNOWN' WHEN {p} < 2 AND {g} >= 2 AND {g} > {p} + 1 THEN 'RECOVERY' WHEN {g} > 2 AND {c} < 3 THEN 'GOLDILOCKS' "
            f"WHEN {g} > 2 AND {c} >= 3 THEN 'OVERHEATING' WHEN {g} < 2 AND {c} >= 3 THEN 'STAGFLATION' WHEN {g} < 2 AND {c} < 3 THEN 'RECESSION' ELSE 'UNKNOWN' END")


REGH = YOY + f""", gq AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date, (avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END) - 25.0) * 4 + 2 AS gdp FROM lineitem GROUP BY 1),
  gp AS (SELECT *, lag(gdp) OVER (ORDER BY date) AS prev_gdp FROM gq),
  rh0 AS (SELECT y.date, y.cpi_yoy + 3 AS cpi, y.growth, g.gdp, g.prev_gdp FROM yoy y ASOF LEFT JOIN gp g ON y.date >= g.date),
  rh AS (SELECT *, {_us()} AS us_regime, CASE WHEN cpi IS NULL OR gdp IS NULL THEN 'UNKNOWN' WHEN gdp + 4 >= 6 AND cpi + 2 < 5 THEN 'INDIA_GOLDILOCKS' WHEN gdp + 4 >= 6 THEN 'INDIA_OVERHEATING'
   WHEN gdp + 4 < 5 AND cpi + 2 >= 6 THEN 'INDIA_STAGFLATION' WHEN gdp + 4 < 5 AND cpi + 2 < 5 THEN 'INDIA_SLOWDOWN' WHEN cpi + 2 >= 6 THEN 'INDIA_OVERHEATING' ELSE 'INDIA_SLOWDOWN' END AS regional FROM rh0),
  tr0 AS (SELECT *, lag(us_regime, 1) OVER (ORDER BY date) AS a, lag(us_regime, 2) OVER (ORDER BY date) AS b FROM rh),
  tr AS (SELECT *, CASE WHEN a IN ('STAGFLATION', 'RECESSION') AND b IN ('STAGFLATION', 'RECESSION') AND us_regime IN ('GOLDILOCKS', 'RECOVERY', 'OVERHEATING') THEN 'REGIME_IMPROVING'
   WHEN a IN ('STAGFLATION', 'RECESSION') AND b IN ('STAGFLATION', 'RECESSION') AND gdp > prev_gdp THEN 'POTENTIAL_RECOVERY'
   WHEN a = 'GOLDILOCKS' AND b = 'GOLDILOCKS' AND us_regime IN ('OVERHEATING', 'STAGFLATION', 'RECESSION') THEN 'REGIME_DETERIORATING'
   WHEN a = 'OVERHEATING' AND b = 'OVERHEATING' AND gdp < prev_gdp AND us_regime IN ('STAGFLATION', 'RECESSION') THEN 'STAGFLATION_RISK'
   WHEN a = 'OVERHEATING' AND b = 'OVERHEATING' AND us_regime = 'GOLDILOCKS' THEN 'DISINFLATION' END AS transition FROM tr0)"""


def regime_history(spark, sf):
    """Monthly regimes with the last known quarterly growth."""
    li = table(spark, sf, "lineitem")
    gdp = li.groupBy(F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("date")).agg(
        ((F.avg(F.when(F.col("l_returnflag") == "N", F.col("l_quantity"))) - 25.0) * 4 + 2).alias("gdp"))
    gdp = gdp.withColumn("prev_gdp", lag("gdp", by=()))
    m = _yoy(spark, sf).select("date", (F.col("cpi_yoy") + 3).alias("cpi"))
    h = asof_join(m, gdp, ["gdp", "prev_gdp"], by=())
    return h.withColumns({
        "us_regime": R.macro_regime_us("cpi", "gdp", "prev_gdp"),
        "regional": R.macro_regime_regional(F.col("cpi") + 2, F.col("gdp") + 4)})


@query("rg_22_macro_regime_us", f"WITH {REGH} SELECT date, us_regime FROM rh")
def macro_regime_us(spark, sf):
    return regime_history(spark, sf).select("date", "us_regime")


@query("rg_23_macro_regime_regional", f"WITH {REGH} SELECT date, regional, {map_sql('regional', R.TO_GENERIC, 'UNKNOWN')} AS generic FROM rh")
def macro_regime_regional(spark, sf):
    from barloom.functions.scalar import map_label

    return regime_history(spark, sf).select("date", "regional", map_label("regional", R.TO_GENERIC, "UNKNOWN").alias("generic"))


_GEN = map_sql("regional", R.TO_GENERIC, "UNKNOWN")


@query("rg_24_regime_transition_divergence", f"WITH {REGH} SELECT date, us_regime, transition, CASE WHEN us_regime = {_GEN} THEN 'ALIGNED_' || us_regime ELSE us_regime || '_VS_' || {_GEN} END AS divergence FROM tr")
def regime_transition(spark, sf):
    from barloom.functions.scalar import map_label

    t = R.transition(regime_history(spark, sf))
    return t.select("date", "us_regime", "transition", R.divergence("us_regime", map_label("regional", R.TO_GENERIC, "UNKNOWN")).alias("divergence"))


_HALF = "CASE WHEN transition LIKE '%POTENTIAL%' THEN 0.5 ELSE 1.0 END"
_ADJ = {n: map_sql("us_regime", {k: v[i] for k, v in R.US_ADJUST.items()}, 0.0) for i, n in enumerate(("adj_sp500", "adj_gold", "adj_silver", "adj_crude"))}
_ADJ["adj_nifty"] = f"({map_sql('regional', R.REGIONAL_ADJUST, 0.0)} + {_ADJ['adj_sp500']} * 0.30)"


@query("rg_25_regime_adjustments", f"WITH {REGH} SELECT date, {', '.join(f'round({e} * {_HALF}, 4) AS {n}' for n, e in _ADJ.items())} FROM tr")
def regime_adjustments(spark, sf):
    return R.regime_adjustments(R.transition(regime_history(spark, sf))).select("date", *_ADJ)


LIQ = f"""liq AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) * 500 AS tga, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) * 200 AS bs,
   (avg(l_discount) * 100 - 5.0) * 4 AS tp, (avg(l_discount) * 100 - avg(l_tax) * 100 - 1.0) * 3 AS ys, avg(CASE WHEN l_returnflag = 'R' THEN l_tax END) * 100 AS hy FROM lineitem GROUP BY 1),
  ls AS (SELECT *, {clip_sql('(tga - lag(tga, 4) OVER (ORDER BY date)) / -200000.0', -1.0, 1.0)} AS tga_score, {clip_sql('(bs - lag(bs, 4) OVER (ORDER BY date)) / 100000.0', -1.0, 1.0)} AS bs_score,
   {clip_sql('-tp', -1.0, 1.0)} AS tp_score, {clip_sql('ys / 2', -1.0, 1.0)} AS ys_score, {clip_sql('(hy - 4) / -4', -1.0, 1.0)} AS hy_score FROM liq),
  lc AS (SELECT *, round({clip_sql('(' + ' + '.join(f'coalesce({c}, 0) * {x}' for c, x in R.PULSE_WEIGHTS.items()) + ') / (' + ' + '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE {x} END' for c, x in R.PULSE_WEIGHTS.items()) + ')::DOUBLE', -1.0, 1.0)}, 4) AS composite FROM ls)"""


def liquidity(spark, sf):
    li = table(spark, sf, "lineitem")
    q, f = F.col("l_quantity"), F.col("l_returnflag")
    disc, tax = F.avg("l_discount") * 100, F.avg("l_tax") * 100
    weekly = li.groupBy(F.trunc(F.col("l_shipdate").cast("date"), "week").alias("date")).agg(
        (F.sum(F.when(f == "A", q)) * 500).alias("tga"), (F.sum(F.when(f == "N", q)) * 200).alias("bs"),
        ((disc - 5.0) * 4).alias("tp"), ((disc - tax - 1.0) * 3).alias("ys"),
        (F.avg(F.when(f == "R", F.col("l_tax"))) * 100).alias("hy"))
    return R.liquidity_pulse(weekly)


@query("rg_26_liquidity_pulse", f"WITH {LIQ} SELECT date, composite, {ladder_sql('composite', R.PULSE_STEPS, 'HIGHLY_RESTRICTIVE')} AS regime, {ladder_sql('composite', [('>=', 0.30, 0.05), ('<=', -0.30, -0.05)], 0.0)} AS overlay FROM lc")
def liquidity_pulse(spark, sf):
    return liquidity(spark, sf).select("date", "composite", "regime", "overlay")


@query("rg_27_fiscal_stance", f"""WITH {V.SERIES_M}, a AS (SELECT series_id, date, abs({roll('avg', 'value', 3, by='series_id')}) AS r, abs({roll('avg', 'value', 3, by='series_id', skip=3)}) AS p FROM series_m),
  c AS (SELECT series_id, date, CASE WHEN p = 0 THEN 1.0 ELSE r / p END AS accel FROM a)
  SELECT series_id, date, round(accel, 6) AS accel, {ladder_sql('accel', [('>=', 1.20, 'STIMULATIVE'), ('<=', 0.80, 'RESTRICTIVE')], 'NEUTRAL', 'UNAVAILABLE')} AS stance FROM c""")
def fiscal_stance(spark, sf):
    return _r(R.fiscal_stance(V.series_m(spark, sf)), "series_id", "date", "stance", accel=6)


COMPL = LIQ + f""", cl0 AS (SELECT *, CASE WHEN tp > 0 THEN 'RISK_ON' ELSE 'RISK_OFF' END AS cr, CASE WHEN ys < 0 THEN 'FALLING' ELSE 'RISING' END AS yd FROM ls),
  cl1 AS (SELECT date, {clip_sql(' + '.join(f'coalesce({c}, 0) * {x}' for c, x in R.LIQUIDITY_WEIGHTS.items() if c not in ('corr_score', 'yield_score')) + f" + ({map_sql('cr', R.CORR_SCORE, 0.0)}) * 0.10 + ({map_sql('yd', R.YIELD_SCORE, 0.0)}) * 0.10", -1.0, 1.0)} AS liquidity FROM cl0),
  cl2 AS (SELECT *, {ladder_sql('liquidity', R.LIQUIDITY_STEPS, 'SCARCE')} AS band FROM cl1),
  cl3 AS (SELECT *, {map_sql('band', R.LIQUIDITY_ADJUST, 0.0)} AS adjustment, avg(liquidity) OVER (ORDER BY date ROWS 29 PRECEDING) AS mean30 FROM cl2)"""


def _composite_liquidity(spark, sf):
    d = liquidity(spark, sf).drop("regime").withColumns({
        "corr_regime": F.when(F.col("tp") > 0, "RISK_ON").otherwise("RISK_OFF"),
        "yield_direction": F.when(F.col("ys") < 0, "FALLING").otherwise("RISING")})
    return R.composite_liquidity(d)


@query("rg_28_composite_liquidity", f"WITH {COMPL} SELECT date, round(liquidity, 6) AS liquidity, band, adjustment, round(mean30, 6) AS mean30 FROM cl3")
def composite_liquidity(spark, sf):
    return _r(_composite_liquidity(spark, sf), "date", "band", "adjustment", liquidity=6, mean30=6)


@query("rg_28_asset_adjustments", f"WITH {COMPL} SELECT date, asset, round(adjustment * m, 4) AS asset_adjustment FROM cl3, (VALUES {', '.join(f'({chr(39)}{a}{chr(39)}, CAST({m} AS DOUBLE))' for a, m in R.ASSET_SENSITIVITY.items())}) v(asset, m)")
def asset_adjustments(spark, sf):
    return R.asset_adjustments(_composite_liquidity(spark, sf)).select("date", "asset", "asset_adjustment")


@query("rg_29_rv_ratio_signal", f"""WITH {V.WIN}, n AS (SELECT date, p3 / p2 AS ratio, row_number() OVER (ORDER BY date) AS rn FROM win),
  k AS (SELECT a.date, a.ratio, CASE WHEN count(*) >= 30 THEN CAST(count(*) FILTER (h.ratio < a.ratio) + (count(*) FILTER (h.ratio = a.ratio) + 1) / 2.0 AS DOUBLE) / count(*) * 100 END AS pct_roll FROM n a JOIN n h ON h.rn BETWEEN a.rn - 1259 AND a.rn GROUP BY 1, 2),
  f AS (SELECT date, CAST(rank() OVER (ORDER BY ratio) + (count(*) OVER (PARTITION BY ratio) - 1) / 2.0 AS DOUBLE) / count(*) OVER () * 100 AS pct_full FROM n),
  s AS (SELECT date, pct_roll, pct_full, {ladder_sql('pct_roll', R.RV_STEPS, 'NEUTRAL', 'UNKNOWN')} AS rv_signal FROM k JOIN f USING (date)),
  l AS (SELECT *, lag(rv_signal) OVER (ORDER BY date) AS p FROM s)
  SELECT date, round(pct_roll, 4) AS pct_roll, round(pct_full, 4) AS pct_full, rv_signal, rv_signal LIKE 'EXTREME%' AND (p IS NULL OR p NOT LIKE 'EXTREME%') AS new_extreme FROM l""")
def rv_ratio_signal(spark, sf):
    d = V.wide_inner(spark, sf).select("date", (F.col("p3") / F.col("p2")).alias("ratio"))
    return _r(R.rv_ratio_signal(d), "date", "rv_signal", "new_extreme", pct_roll=4, pct_full=4)


@query("rg_30_fx_trend", f"""WITH {V.RETS}, t AS (SELECT symbol, date, (close / lag(close, 19) {O} - 1) * 100 AS mom20, (close / lag(close, 59) {O} - 1) * 100 AS mom60, ({roll('stddev_samp', 'ret', 20)}) * sqrt(252) * 100 AS vol20 FROM rets)
  SELECT symbol, date, round(mom20, 4) AS mom20, round(mom60, 4) AS mom60, round(vol20, 4) AS vol20, {ladder_sql('mom20', [('>', 0.5, 'WEAKENING'), ('<', -0.5, 'STRENGTHENING')], 'STABLE')} AS trend FROM t""")
def fx_trend(spark, sf):
    d = R.fx_trend(V.bars(spark, sf).select("symbol", "date", "close"))
    return _r(d, "symbol", "date", "trend", mom20=4, mom60=4, vol20=4)


@query("rg_31_real_rate_curve", f"WITH {YOY} SELECT date, round(policy - cpi_yoy, 6) AS real_rate, round(y10 - cpi_yoy, 6) AS real_yield, y10 - y2 < 0 AS inverted FROM yoy")
def real_rate_curve(spark, sf):
    y = _yoy(spark, sf)
    return y.select("date", rnd(F.col("policy") - F.col("cpi_yoy")).alias("real_rate"), rnd(F.col("y10") - F.col("cpi_yoy")).alias("real_yield"),
                    (F.col("y10") - F.col("y2") < 0).alias("inverted"))
