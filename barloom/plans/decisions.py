"""Analogs, decisions, levels, sizing and friction (AN, DC, LV, RK, FR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.rolling import pct_change, pct_lt_tail, range_position, rolling, sma
from barloom.functions.scalar import map_label
from barloom.operators import analogs as A
from barloom.operators import decisions as D
from barloom.operators import levels as L
from barloom.operators.align import align_ffill, asof_join
from barloom.operators.pairs import corr_matrix
from barloom.operators.text import context_score, sentiment_daily, tag_topics
from barloom.operators.signals import ASSET_CLASS, confidence, hit_rate, momentum_score, score_to_signal, stable_signal
from barloom.plans import views as V
from barloom.plans.aggregates import CORR
from barloom.plans.registry import query
from barloom.plans.signals import CONF, ROLE, STABLE, hit_sql
from barloom.plans.text import SCORED, TOPIC_CONTEXTS, TOPICS
from barloom.plans.views import O, SIG, ladder_sql, map_sql, rnd, roll
from barloom.plans.windows import LEVELS_HISTORY_SQL, LEVELS_SQL, _pos_sql
from barloom.session import stored
from barloom.sources.readers import read_latest

N = {"by": None}

# ------------------------------------------------------------------------- analogs

_MOM = {"gold": "p3", "sp": "p2", "nifty": "p1", "crude": "p4"}
_F = {"vix_pct": "CAST(rank() OVER (ORDER BY p5) + (count(*) OVER (PARTITION BY p5) - 1) / 2.0 AS DOUBLE) / count(*) OVER ()",
      "vix_chg20": "p5 / lag(p5, 20) OVER (ORDER BY date) - 1", "spread": "spread", "spread_chg20": "spread - lag(spread, 20) OVER (ORDER BY date)",
      "sp_vs_ma200": f"p2 / ({roll('avg', 'p2', 200, **N)}) - 1"}
_F.update({f"{n}_mom{k}": f"{c} / lag({c}, {k}) OVER (ORDER BY date) - 1" for n, c in _MOM.items() for k in (20, 60)})
FEAT = V.WIN + ", " + V.MACRO + f""", ws AS (SELECT w.*, m.spread FROM win w ASOF LEFT JOIN (SELECT date, y10 - y2 AS spread FROM macro) m ON w.date >= m.date),
  f0 AS (SELECT date, {', '.join(f'{_F[f]} AS {f}' for f in A.FEATURES)} FROM ws), ft AS (SELECT * FROM f0 WHERE {' AND '.join(f'{f} IS NOT NULL' for f in A.FEATURES)})"""


def features(spark, sf):
    m = V.macro(spark, sf).select("date", (F.col("y10") - F.col("y2")).alias("spread"))
    p = asof_join(V.wide_inner(spark, sf), m, ["spread"], by=())
    return A.state_features(p, {"vix": "p5", "spread": "spread", **_MOM})


@query("an_1_state_features", f"WITH {FEAT} SELECT date, {', '.join(f'round({f}, 6) AS {f}' for f in A.FEATURES)} FROM ft")
def state_features(spark, sf):
    return features(spark, sf).select("date", *[rnd(f).alias(f) for f in A.FEATURES])


SIM = FEAT + f""", hs AS (SELECT * FROM ft WHERE date < (SELECT max(date) FROM ft) - 90), tg AS (SELECT * FROM ft WHERE date = (SELECT max(date) FROM ft)),
  sts AS (SELECT count(*) AS n, {', '.join(f'avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}' for f in A.FEATURES)} FROM hs),
  zz AS (SELECT hs.date, {', '.join(f'(hs.{f} - m_{f}) / s_{f} AS a_{f}, (tg.{f} - m_{f}) / s_{f} AS b_{f}' for f in A.FEATURES)} FROM hs, tg, sts WHERE n >= 100),
  si AS (SELECT date AS analog_date, ({' + '.join(f'a_{f} * b_{f}' for f in A.FEATURES)}) / sqrt(({' + '.join(f'a_{f} * a_{f}' for f in A.FEATURES)}) * ({' + '.join(f'b_{f} * b_{f}' for f in A.FEATURES)})) AS similarity FROM zz),
  an AS (SELECT * FROM (SELECT * FROM si ORDER BY similarity DESC, analog_date LIMIT 5) WHERE similarity >= 0.3)"""


def _similar(spark, sf):
    return A.similar_states(stored(features(spark, sf), "features"), min_similarity=0.3)


@query("an_2_similar_states", f"WITH {SIM} SELECT analog_date, round(similarity, 6) AS similarity FROM an")
def similar_states(spark, sf):
    return _similar(spark, sf).withColumn("similarity", rnd("similarity"))


OUT = SIM + f""", ae AS (SELECT symbol, analog_date, similarity FROM an, (VALUES {', '.join(f"('{s}')" for s in V.SYMBOLS)}) v(symbol)),
  nb AS (SELECT symbol, date, close, row_number() {O} AS n FROM bars),
  ab AS (SELECT e.*, b.date AS bd, b.close AS base, b.n, row_number() OVER (PARTITION BY e.symbol, analog_date ORDER BY abs(b.date - analog_date), b.date) AS k FROM ae e JOIN nb b ON e.symbol = b.symbol),
  ao AS (SELECT a.symbol, analog_date, similarity, CAST(h AS INTEGER) AS horizon, (p.close / base - 1) * 100 AS forward_return FROM (SELECT * FROM ab WHERE k = 1) a, (VALUES (10), (30), (60)) v(h), nb p WHERE p.symbol = a.symbol AND p.n = a.n + h)"""


def _outcomes(spark, sf):
    analogs = stored(_similar(spark, sf), "analogs")
    return A.analog_outcomes(analogs, V.bars(spark, sf), list(V.SYMBOLS))


@query("an_3_analog_outcomes", f"WITH {OUT} SELECT symbol, analog_date, horizon, round(forward_return, 4) AS forward_return FROM ao")
def analog_outcomes(spark, sf):
    return _outcomes(spark, sf).select("symbol", "analog_date", "horizon", rnd("forward_return", 4).alias("forward_return"))


_Q = {"p10_return": 0.1, "p25_return": 0.25, "median_return": 0.5, "p75_return": 0.75, "p90_return": 0.9}


@query("an_4_outcome_summary", f"WITH {OUT} SELECT symbol, horizon, {', '.join(f'round(quantile_cont(forward_return, {v}), 4) AS {k}' for k, v in _Q.items())}, round(avg(forward_return), 4) AS mean_return, "
       "round(greatest(0.3, least(0.8, avg(CASE WHEN forward_return > 0 THEN 1.0 ELSE 0.0 END))) * 100, 4)::DOUBLE AS prob_positive, CAST(count(*) AS BIGINT) AS n_analogs FROM ao GROUP BY 1, 2")
def outcome_summary(spark, sf):
    s = A.outcome_summary(_outcomes(spark, sf))
    return s.withColumns({c: rnd(c, 4) for c in (*_Q, "mean_return", "prob_positive")})


# Analogs of every date: the panel carried forward, so that a date counts for all series.
_CARRY = ", ".join(f"last_value({p} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS {p}" for p in V.PANEL)
_FH = {**_F, "vix_pct": "CASE WHEN len(l5) = 252 THEN (len(list_filter(l5, lambda x: x < p5)) + (len(list_filter(l5, lambda x: x = p5)) + 1) / CAST(2 AS DOUBLE)) / 252 END"}
_ALL = " AND ".join(f"{f} IS NOT NULL" for f in A.FEATURES)
_SIMH = (f"({' + '.join(f'((c.{f} - m_{f}) / s_{f}) * ((t.{f} - m_{f}) / s_{f})' for f in A.FEATURES)}) / sqrt(({' + '.join(f'((c.{f} - m_{f}) / s_{f}) ** 2' for f in A.FEATURES)})"
         f" * ({' + '.join(f'((t.{f} - m_{f}) / s_{f}) ** 2' for f in A.FEATURES)}))")
HIST = f"""wc AS (SELECT date, {_CARRY} FROM wide), wci AS (SELECT * FROM wc WHERE {' AND '.join(f'{p} IS NOT NULL' for p in V.PANEL)}),
  wcs AS (SELECT w.*, m.spread, list(p5) OVER (ORDER BY w.date ROWS 251 PRECEDING) AS l5 FROM wci w ASOF LEFT JOIN (SELECT date, y10 - y2 AS spread FROM macro) m ON w.date >= m.date),
  fh0 AS (SELECT date, {', '.join(f'{_FH[f]} AS {f}' for f in A.FEATURES)} FROM wcs), fh AS MATERIALIZED (SELECT * FROM fh0 WHERE {_ALL}),
  hm AS MATERIALIZED (SELECT t.date, count(*) AS n, {', '.join(f'avg(c.{f}) AS m_{f}, stddev_pop(c.{f}) AS s_{f}' for f in A.FEATURES)} FROM fh t JOIN fh c ON c.date < t.date - 90 GROUP BY t.date),
  hsim AS (SELECT t.date, c.date AS analog_date, {_SIMH} AS similarity FROM fh t JOIN hm USING (date) JOIN fh c ON c.date < t.date - 90 WHERE n >= 100),
  han AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY date ORDER BY similarity DESC, analog_date) AS place FROM hsim WHERE similarity >= 0.7 QUALIFY place <= 5)"""
HOUT = HIST + """, hd AS (SELECT DISTINCT analog_date FROM han), hnb AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM bars),
  hab AS (SELECT b.symbol, analog_date, b.close AS base, b.n FROM hd, hnb b QUALIFY row_number() OVER (PARTITION BY b.symbol, analog_date ORDER BY abs(b.date - analog_date), b.date) = 1),
  hao AS (SELECT a.symbol, analog_date, CAST(h AS INTEGER) AS horizon, p.date AS known, (p.close / base - 1) * 100 AS forward_return FROM hab a, (VALUES (10), (30), (60)) v(h), hnb p WHERE p.symbol = a.symbol AND p.n = a.n + h),
  ho AS (SELECT han.date, symbol, analog_date, horizon, forward_return FROM han JOIN hao USING (analog_date) WHERE known <= han.date)"""
_PROB = "round(greatest(0.3, least(0.8, avg(CASE WHEN forward_return > 0 THEN 1.0 ELSE 0.0 END))) * 100, 4)::DOUBLE"


def feature_history(spark, sf):
    """State features of every date from the panel carried forward; the volatility rank looks back 252 rows."""
    m = V.macro(spark, sf).select("date", (F.col("y10") - F.col("y2")).alias("spread"))
    p = asof_join(align_ffill(V.wide(spark, sf), V.PANEL), m, ["spread"], by=())
    return A.state_features(p, {"vix": "p5", "spread": "spread", **_MOM}, history=252)


def _history(spark, sf):
    return stored(A.analog_history(stored(feature_history(spark, sf), "features")), "analogs")


@query("an_2_history", f"WITH {V.WIDE}, {V.MACRO}, {HIST} SELECT date, analog_date, CAST(place AS INTEGER) AS place, round(similarity, 6) AS similarity FROM han")
def analog_history(spark, sf):
    return _history(spark, sf).select("date", "analog_date", "place", rnd("similarity").alias("similarity"))


def outcome_history(spark, sf):
    """Outcome summary of every date, symbol and horizon."""
    outcomes = A.history_outcomes(_history(spark, sf), V.bars(spark, sf), list(V.SYMBOLS))
    return A.outcome_summary(outcomes, ("date", "symbol", "horizon"))


@query("an_4_history", f"WITH {V.WIDE}, {V.MACRO}, {HOUT} SELECT date, symbol, horizon, {', '.join(f'round(quantile_cont(forward_return, {v}), 4) AS {k}' for k, v in _Q.items())}, "
       f"round(avg(forward_return), 4) AS mean_return, {_PROB} AS prob_positive, CAST(count(*) AS BIGINT) AS n_analogs FROM ho GROUP BY 1, 2, 3")
def outcome_summary_history(spark, sf):
    return outcome_history(spark, sf).withColumns({c: rnd(c, 4) for c in (*_Q, "mean_return", "prob_positive")})


# ------------------------------------------------------------------------- decisions

_CLS = map_sql("symbol", {s: ASSET_CLASS[a] for s, a in ROLE.items()})
# The topic whose headlines speak of a symbol.
SYMBOL_TOPIC = dict(zip(V.SYMBOLS, ("T_COMMON", "T_EN", "T_AI", "T_LICENSE", "T_MAIL")))
_NEWS = SCORED.replace(V.HEADLINES, V.NEWS) + ", ns AS (SELECT date AS nd, " + ", ".join(
    f"coalesce(avg(score) FILTER (list_contains(tags, '{t}')), avg(score)) AS {t}" for t in SYMBOL_TOPIC.values()) + " FROM sc GROUP BY date)"
_SENT = "CASE symbol " + " ".join(f"WHEN '{s}' THEN {t}" for s, t in SYMBOL_TOPIC.items()) + " END"
MACRO_L = "CASE asset_class " + " ".join(f"WHEN '{c}' THEN {map_sql('regime', t, 0.0)}" for c, t in D.REGIME_SCORES.items()) + " END"
DEC = f"""{V.WIDE}, {V.MACRO}, {HOUT}, {_NEWS}, {V.mom_sql('bars')}, {STABLE}, {hit_sql('mom')},
  vx0 AS (SELECT date, p5 / 12500.0 AS vix, row_number() OVER (ORDER BY date) AS rn FROM wide WHERE p5 IS NOT NULL),
  vx AS (SELECT a.date, a.vix, round(CAST(count(*) FILTER (h.vix < a.vix) AS DOUBLE) / count(*) * 100, 1) AS vix_pct FROM vx0 a JOIN vx0 h ON h.rn BETWEEN a.rn - 755 AND a.rn GROUP BY 1, 2),
  sp AS (SELECT date, p2 > ({roll('avg', 'p2', 200, **N)}) AS above FROM wide WHERE p2 IS NOT NULL),
  mk AS (SELECT vx.date, vix, vix_pct, CASE WHEN vix > 30 THEN 'Crisis' WHEN vix > 20 AND NOT above THEN 'Bear Market' WHEN vix <= 20 AND above THEN 'Bull Market' ELSE 'Sideways' END AS regime FROM vx LEFT JOIN sp ON vx.date = sp.date),
  up AS (SELECT symbol, date, greatest(0.3, least(0.8, avg(CASE WHEN forward_return > 0 THEN 1.0 ELSE 0.0 END)))::DOUBLE * 100 AS prob_positive FROM ho WHERE horizon = 30 GROUP BY 1, 2),
  dl AS (SELECT symbol, date, last_day(date) AS d1, score, signal, stable, hit_rate, prob_positive, {_CLS} AS asset_class, regime, vix, vix_pct FROM ss JOIN hr USING (symbol, date) LEFT JOIN up USING (symbol, date) LEFT JOIN mk USING (date)),
  dn AS (SELECT d.*, {_SENT} AS sentiment FROM dl d ASOF LEFT JOIN ns ON d.date >= ns.nd),
  dm AS (SELECT d.*, m.spread FROM dn d ASOF LEFT JOIN (SELECT date AS md, y10 - y2 AS spread FROM macro) m ON d.date >= m.md),
  lay AS (SELECT *, coalesce(score, 0) AS signal_layer, round((coalesce(prob_positive, 50) - 50) / 50, 3) AS analog_layer, {V.clip_sql('coalesce(sentiment, 0)', -1.0, 1.0)} AS sentiment_layer, {MACRO_L} AS macro_layer,
   coalesce(round(CASE WHEN spread < 0 THEN -0.4 WHEN spread > 1 THEN 0.3 ELSE spread * 0.3 END, 3), 0.1) AS yield_layer, round(-(coalesce(vix_pct, 50) - 50) / 100, 3) AS vix_layer FROM dm),
  fu0 AS (SELECT * REPLACE (signal_layer * CASE WHEN stable = signal THEN 1.0 ELSE 0.5 END * CASE WHEN (hit_rate - 0.5) * 2 + 1 < 0.5 THEN 0.5 WHEN (hit_rate - 0.5) * 2 + 1 > 1.5 THEN 1.5 ELSE (hit_rate - 0.5) * 2 + 1 END AS signal_layer) FROM lay),
  fu AS (SELECT *, {' + '.join(f'{k}_layer * {w}' for k, w in D.BASE_WEIGHTS.items())} AS combined FROM fu0),
  ag AS (SELECT *, CASE WHEN combined > 0 THEN {' + '.join(f'CAST({k}_layer > 0 AS INTEGER)' for k in D.LAYERS)} WHEN combined < 0 THEN {' + '.join(f'CAST({k}_layer < 0 AS INTEGER)' for k in D.LAYERS)} ELSE 0 END * 100.0::DOUBLE / 6 AS agreement FROM fu),
  dc AS (SELECT *, CASE WHEN combined >= 0.2 AND agreement >= 50 THEN 'LONG' WHEN combined <= -0.2 AND agreement >= 50 THEN 'SHORT' ELSE 'NO TRADE' END AS decision,
   CASE WHEN abs(combined) >= 0.4 AND agreement >= 70 THEN 'HIGH' WHEN abs(combined) >= 0.25 AND agreement >= 60 THEN 'MEDIUM' WHEN abs(combined) >= 0.15 AND agreement >= 50 THEN 'LOW' ELSE 'NONE' END AS conf FROM ag)"""


def decision_inputs(spark, sf):
    b = V.bars(spark, sf).select("symbol", "date", "close")
    m = momentum_score(b).withColumn("signal", score_to_signal("score"))
    m = hit_rate(stable_signal(m))
    prob = outcome_history(spark, sf).filter("horizon = 30").select("symbol", "date", "prob_positive")
    m = m.join(prob, ["symbol", "date"], "left")
    vix = b.filter("symbol = '5-LOW'").select("date", (F.col("close") / 12500.0).alias("vix"))
    vix = vix.withColumn("vix_pct", F.round(pct_lt_tail("vix", 756, by=()) * 100.0, 1))
    sp = b.filter("symbol = '2-HIGH'").select("date", (F.col("close") > sma("close", 200, by=())).alias("above"))
    v, up = F.col("vix"), F.col("above")
    regime = F.when(v > 30, "Crisis").when((v > 20) & ~up, "Bear Market").when((v <= 20) & up, "Bull Market").otherwise("Sideways")
    mk = vix.join(sp, "date", "left").select("date", "vix", "vix_pct", regime.alias("regime"))
    spread = V.macro(spark, sf).select("date", (F.col("y10") - F.col("y2")).alias("spread"))
    scored = context_score(tag_topics(V.news(spark, sf), TOPICS), TOPIC_CONTEXTS)
    topics = list(SYMBOL_TOPIC.values())
    j = m.join(mk, "date", "left")
    days = asof_join(j.select("date").distinct(), spread, ["spread"], by=())
    days = asof_join(days, sentiment_daily(scored, topics), topics, by=())
    sentiment = F.coalesce(*(F.when(F.col("symbol") == s, F.col(t)) for s, t in SYMBOL_TOPIC.items()))
    return j.join(days, "date", "left").withColumns({
        "sentiment": sentiment, "asset_class": map_label("symbol", {s: ASSET_CLASS[a] for s, a in ROLE.items()})}).drop(*topics)


def _w():
    from barloom.functions.rolling import ordered

    return ordered()


_LAY = [f"{k}_layer" for k in D.LAYERS]


@query("dc_1_layer_scores", f"WITH {DEC} SELECT symbol, date, {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in _LAY)} FROM lay")
def layer_scores(spark, sf):
    return D.layer_scores(decision_inputs(spark, sf)).select("symbol", "date", *[rnd(c).alias(c) for c in _LAY])


def _fused(spark, sf):
    return D.fuse_layers(D.layer_scores(decision_inputs(spark, sf)))


@query("dc_2_fuse_layers", f"WITH {DEC} SELECT symbol, date, round(combined, 6) AS combined FROM fu")
def fuse_layers(spark, sf):
    return _fused(spark, sf).select("symbol", "date", rnd("combined").alias("combined"))


@query("dc_3_decision", f"WITH {DEC} SELECT symbol, date, round(agreement, 4) AS agreement, decision, conf AS confidence FROM dc")
def decision(spark, sf):
    return D.decide(_fused(spark, sf)).select("symbol", "date", rnd("agreement", 4).alias("agreement"), "decision", "confidence")


@query("dc_4_reasons", f"""WITH {DEC} SELECT symbol, date, array_to_string(list_filter(['Signal ' || signal || ' (' || CASE WHEN stable = signal THEN 'stable' ELSE 'not yet stable' END || ')',
  CASE WHEN coalesce(prob_positive, 50) >= 60 THEN 'Analogs bullish' WHEN coalesce(prob_positive, 50) <= 40 THEN 'Analogs bearish' ELSE 'Analogs neutral' END,
  CASE WHEN sentiment > 0.3 THEN 'Sentiment positive' WHEN sentiment < -0.3 THEN 'Sentiment negative' END, 'Regime: ' || coalesce(regime, 'Unknown'),
  CASE WHEN spread < 0 THEN 'Yield curve inverted' WHEN spread IS NOT NULL THEN 'Yield curve normal' END, CASE WHEN vix_pct > 75 THEN 'VIX elevated' WHEN vix_pct < 30 THEN 'VIX calm' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM dm""")
def reasons(spark, sf):
    return decision_inputs(spark, sf).select("symbol", "date", F.array_join(D.reasons(), "; ").alias("reasons"))


@query("dc_5_overlay_adjustments", f"""WITH {DEC}, o1 AS (SELECT symbol, date, CASE WHEN close > 400000 THEN -0.05 ELSE 0.05 END AS a1 FROM bars WHERE volume > 1), o2 AS (SELECT symbol, date, 0.10 AS a2 FROM bars WHERE month(date) = 1)
  SELECT symbol, date, round((coalesce(a1, 0) + coalesce(a2, 0))::DOUBLE, 4) AS overlay, round({V.clip_sql('combined + coalesce(a1, 0) + coalesce(a2, 0)', -1.0, 1.0)}, 6) AS final_score FROM fu LEFT JOIN o1 USING (symbol, date) LEFT JOIN o2 USING (symbol, date)""")
def overlay_adjustments(spark, sf):
    b = V.bars(spark, sf)
    o1 = b.filter("volume > 1").select("symbol", "date", F.when(F.col("close") > 400000, -0.05).otherwise(0.05).alias("adjustment"))
    o2 = b.filter(F.month("date") == 1).select("symbol", "date", F.lit(0.10).alias("adjustment"))
    d = D.overlay_adjustments(_fused(spark, sf), [o1, o2], apply=True)
    return d.select("symbol", "date", rnd("overlay", 4).alias("overlay"), rnd("final_score").alias("final_score"))


# ------------------------------------------------------------------------- levels

ATR = f"""tr0 AS (SELECT *, lag(close) {O} AS pc FROM bars), tr1 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, abs(close / pc - 1) AS ar FROM tr0),
  atr AS (SELECT symbol, date, close, coalesce({roll('avg', 'tr', 14)}, ({roll('avg', 'ar', 14, 1)}) * close) AS atr FROM tr1)"""


@query("lv_1_atr", f"WITH {V.BARS}, {ATR} SELECT symbol, date, round(atr, 6) AS atr FROM atr")
def atr(spark, sf):
    return L.atr(V.bars(spark, sf)).select("symbol", "date", rnd("atr").alias("atr"))


@query("lv_2_volatility", f"""WITH {V.RETS} SELECT symbol, date, round({roll('stddev_samp', 'ret', 20)}, 6) AS daily_std, round(({roll('stddev_samp', 'ret', 20)}) * sqrt(252), 6) AS annual_vol20,
  round(({roll('stddev_samp', 'ret', 60)}) * sqrt(252), 6) AS annual_vol60 FROM rets""")
def volatility(spark, sf):
    d = L.volatility(V.returns(spark, sf))
    return d.select("symbol", "date", *[rnd(c).alias(c) for c in ("daily_std", "annual_vol20", "annual_vol60")])


_TL = {f"ma{n}": roll("avg", "close", n) for n in (20, 60, 200)}
for _n in (20, 60, 252):
    _TL[f"high_{_n}"] = roll("max", "close", _n, 1)
    _TL[f"low_{_n}"] = roll("min", "close", _n, 1)
TECH = f"""{LEVELS_SQL}, tl0 AS (SELECT symbol, date, {', '.join(f'{v} AS {k}' for k, v in _TL.items())} FROM bars), tl AS (SELECT * FROM tl0 JOIN lev USING (symbol) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"""
_TK = [*_TL, "current", "nearest_resistance", "nearest_support"]


@query("lv_3_technical_levels", f"WITH {V.BARS}, {TECH} SELECT symbol, {', '.join(f'round({c}, 6) AS {c}' for c in _TK)} FROM tl")
def technical_levels(spark, sf):
    return L.technical_levels(V.bars(spark, sf)).select("symbol", *[rnd(c).alias(c) for c in _TK])


@query("lv_3_technical_levels_history", f"WITH {V.BARS}, {LEVELS_HISTORY_SQL}, tl0 AS (SELECT symbol, date, {', '.join(f'{v} AS {k}' for k, v in _TL.items())} FROM bars) "
       f"SELECT symbol, date, {', '.join(f'round({c}, 6) AS {c}' for c in _TK)} FROM tl0 JOIN lv USING (symbol, date)")
def technical_levels_history(spark, sf):
    return L.technical_levels_history(V.bars(spark, sf)).select("symbol", "date", *[rnd(c).alias(c) for c in _TK])


LV4 = f"""{V.MACRO}, {HOUT}, {V.mom_sql('bars')}, {ATR}, {TECH},
  fq AS (SELECT symbol, quantile_cont(forward_return, 0.5) AS med0, quantile_cont(forward_return, 0.25) AS p250, quantile_cont(forward_return, 0.75) AS p750 FROM ho WHERE horizon = 30 GROUP BY symbol, date
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
  lb AS (SELECT symbol, CASE WHEN score > 0 THEN 'LONG' ELSE 'SHORT' END AS bias, {ladder_sql('abs(score)', [('>=', 0.40, 'HIGH'), ('>=', 0.25, 'MEDIUM'), ('>=', 0.15, 'LOW')], 'NONE')} AS confidence FROM mom QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
  la AS (SELECT symbol, atr FROM atr QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
  l0 AS (SELECT *, CASE confidence WHEN 'HIGH' THEN 0.85 WHEN 'MEDIUM' THEN 1.0 WHEN 'LOW' THEN 1.2 ELSE 1.4 END::DOUBLE AS w FROM (SELECT *, coalesce(med0, 0.0) AS med, coalesce(p250, -2.0) AS p25, coalesce(p750, 2.0) AS p75 FROM tl LEFT JOIN fq USING (symbol)) t JOIN lb USING (symbol) JOIN la USING (symbol)),
  l1 AS (SELECT *, CASE bias WHEN 'LONG' THEN CASE WHEN current < ma20 THEN current - atr * w ELSE greatest(ma20, nearest_support) * w END ELSE current - atr * 2 * w END AS el,
   CASE bias WHEN 'LONG' THEN current + atr * 2 * w ELSE least(ma20, nearest_resistance) / w END AS eh,
   CASE bias WHEN 'LONG' THEN current * (1 + greatest(med, 1.0) / 100) ELSE greatest(current * (1 + least(p25, -2.0) / 100), nearest_support * 0.98) END AS tl_,
   CASE bias WHEN 'LONG' THEN least(current * (1 + greatest(p75, 2.0) / 100), nearest_resistance * 1.02) ELSE current * (1 + least(med, -1.0) / 100) END AS th FROM l0),
  l2 AS (SELECT *, CASE bias WHEN 'LONG' THEN greatest((el + eh) / 2 - atr * 3 * w, nearest_support - atr) ELSE least((el + eh) / 2 + atr * 3 * w, nearest_resistance + atr) END AS sl FROM l1),
  lv AS (SELECT symbol, bias, confidence, round(el, 0) AS entry_low, round(eh, 0) AS entry_high, round(tl_, 0) AS target_low, round(th, 0) AS target_high, round(sl, 0) AS stop_level,
   coalesce(round(abs((tl_ + th) / 2 - (el + eh) / 2) / nullif(abs((el + eh) / 2 - sl), 0), 1), 0) AS rr_ratio FROM l2)"""


def _levels(spark, sf):
    b = V.bars(spark, sf)
    m = momentum_score(b.select("symbol", "date", "close"))
    bias = m.groupBy("symbol").agg(F.max_by("score", "date").alias("score"))
    bias = bias.select("symbol", F.when(F.col("score") > 0, "LONG").otherwise("SHORT").alias("bias"), confidence("score").alias("confidence"))
    a = L.atr(b).groupBy("symbol").agg(F.max_by("atr", "date").alias("atr"))
    q = outcome_history(spark, sf).filter("horizon = 30").groupBy("symbol").agg(
        F.max_by(F.struct("median_return", "p25_return", "p75_return"), "date").alias("_q")).select("symbol", "_q.*")
    return L.technical_levels(b).join(bias, "symbol").join(a, "symbol").join(q, "symbol", "left")


@query("lv_4_entry_target_stop", f"WITH {V.WIDE}, {LV4} SELECT * FROM lv")
def entry_target_stop(spark, sf):
    return L.entry_target_stop(_levels(spark, sf)).select(
        "symbol", "bias", "confidence", "entry_low", "entry_high", "target_low", "target_high", "stop_level", "rr_ratio")


# ------------------------------------------------------------------------- sizing

KEL = f"""{V.PX}, {V.mom_sql('px')}, {hit_sql('mom')}, kr AS (SELECT symbol, date, close, close / lag(close) {O} - 1 AS ret, abs(close - lag(close) {O}) AS ad FROM px),
  kv AS (SELECT symbol, date, ({roll('avg', 'ad', 14)}) / close * 100 AS atr_pct, ({roll('stddev_samp', 'ret', 60)}) * sqrt(252) AS annual_vol, abs(({roll('avg', 'ret', 60)}) * 6000) AS win_pct FROM kr),
  k0 AS (SELECT symbol, date, score, hit_rate AS p, greatest(win_pct, 0.5) / greatest(atr_pct * 3, 0.5) AS b, annual_vol, win_pct IS NULL OR atr_pct IS NULL AS miss FROM mom JOIN hr USING (symbol, date) JOIN kv USING (symbol, date)),
  k1 AS (SELECT *, CASE WHEN p <= 0 OR b <= 0 THEN 0.0 ELSE {V.clip_sql('(p * b - (1 - p)) / b', 0.0, 1.0)} END AS k FROM k0 WHERE NOT miss),
  k2 AS (SELECT *, CASE WHEN k > 0 THEN least(greatest(k / 2 * 100, 2.0), 20.0) ELSE 0.0 END AS s FROM k1),
  kz AS (SELECT symbol, date, score, round(k * 100, 2) AS kelly_raw, round(s, 2) AS position_pct, round(s * annual_vol * 1.5, 2) AS max_dd_est, annual_vol FROM k2)"""


def _sized(spark, sf):
    p = V.px(spark, sf)
    m = hit_rate(momentum_score(p)).withColumns({"ret": pct_change("close"), "_ad": F.abs(F.col("close") - F.lag("close").over(_w()))})
    m = m.withColumns({
        "atr_pct": sma("_ad", 14) / F.col("close") * 100, "annual_vol": rolling(F.stddev_samp, "ret", 60) * 252 ** 0.5,
        "win_pct": F.abs(sma("ret", 60) * 6000)}).na.drop(subset=["atr_pct", "win_pct"])
    return D.kelly_size(m)


@query("rk_1_kelly_size", f"WITH {KEL} SELECT symbol, date, kelly_raw, position_pct, max_dd_est FROM kz")
def kelly_size(spark, sf):
    return _sized(spark, sf).select("symbol", "date", "kelly_raw", "position_pct", "max_dd_est")


_P5 = "pw AS (SELECT date, " + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN close END) AS {p}" for s, p in V.SYMBOLS.items()) + " FROM px GROUP BY 1), pwi AS (SELECT * FROM pw WHERE " + " AND ".join(f"{p} IS NOT NULL" for p in V.PANEL) + ")"
RKC = f"""{KEL}, {_P5}, pl60 AS (SELECT {', '.join(V.PANEL)} FROM pwi ORDER BY date DESC LIMIT 60),
  pc AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {CORR.format(x=a, y=b)} AS corr FROM pl60" for a, b in V.PAIRS)}),
  bw AS (SELECT a, b, corr FROM pc UNION ALL SELECT b, a, corr FROM pc),
  sz AS (SELECT {map_sql('symbol', V.SYMBOLS)} AS symbol, CASE WHEN score > 0 THEN 'LONG' ELSE 'SHORT' END AS bias, greatest(position_pct, 5.0) AS position_pct, annual_vol FROM kz QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
  pp AS (SELECT bw.a AS symbol, corr FROM bw JOIN sz x ON bw.a = x.symbol JOIN sz y ON bw.b = y.symbol WHERE x.bias = y.bias),
  pg AS (SELECT symbol, count(*) FILTER (corr > 0.1) AS n_high, count(*) FILTER (corr < 0.0) AS n_low FROM pp GROUP BY 1),
  ch AS (SELECT sz.*, coalesce(n_high, 0) AS n_high, CASE WHEN n_high > 0 THEN 'HIGH_CORR_WARNING' WHEN n_low > 0 THEN 'DIVERSIFIED' ELSE 'OK' END AS corr_flag, round(position_pct * pow(0.7, coalesce(n_high, 0)), 2) AS adj_position FROM sz LEFT JOIN pg USING (symbol)),
  rv AS (SELECT sum(v) AS v FROM (SELECT pow(adj_position / 100 * annual_vol, 2) AS v FROM ch UNION ALL SELECT x.adj_position / 100 * x.annual_vol * y.adj_position / 100 * y.annual_vol * coalesce(corr, 0.3) FROM bw JOIN ch x ON bw.a = x.symbol JOIN ch y ON bw.b = y.symbol)),
  pd AS (SELECT sqrt(greatest(v, 0)) AS port_vol, round(sqrt(greatest(v, 0)) * 165, 2) AS max_dd_pct FROM rv), pdl AS (SELECT *, CASE WHEN max_dd_pct >= 25 THEN 'CRITICAL' WHEN max_dd_pct >= 15 THEN 'WARNING' ELSE 'OK' END AS level FROM pd)"""


def _haircut(spark, sf):
    last = _sized(spark, sf).groupBy("symbol").agg(F.max_by(F.struct("score", "position_pct", "annual_vol"), "date").alias("_r")).select("symbol", "_r.*")
    sz = last.select(map_label("symbol", V.SYMBOLS).alias("symbol"), F.when(F.col("score") > 0, "LONG").otherwise("SHORT").alias("bias"),
                     F.greatest("position_pct", F.lit(5.0)).alias("position_pct"), "annual_vol")
    from barloom.operators.align import align_inner, panel

    wide = align_inner(panel(V.px(spark, sf), V.SYMBOLS), V.PANEL)
    corr = corr_matrix(read_latest(wide, 60), V.PAIRS)
    return D.corr_haircut(sz, corr, high=0.1, low=0.0), corr


@query("rk_2_corr_haircut", f"WITH {RKC} SELECT symbol, bias, corr_flag, CAST(n_high AS BIGINT) AS n_high, adj_position FROM ch")
def corr_haircut(spark, sf):
    return _haircut(spark, sf)[0].select("symbol", "bias", "corr_flag", "n_high", "adj_position")


@query("rk_3_portfolio_vol_dd", f"WITH {RKC} SELECT round(port_vol, 6) AS port_vol, max_dd_pct, level FROM pdl")
def portfolio_vol_dd(spark, sf):
    return D.portfolio_vol_dd(*_haircut(spark, sf)).withColumn("port_vol", rnd("port_vol"))


@query("rk_4_action_text", f"""WITH {RKC} SELECT symbol, CASE WHEN adj_position = 0 THEN 'WAIT' WHEN level = 'CRITICAL' THEN bias || ' ' || format('{{:.1f}}%', adj_position) || ' CUT TO ' || format('{{:.1f}}%', adj_position * 0.5)
  ELSE bias || ' ' || format('{{:.1f}}%', adj_position) || ' of portfolio' || CASE corr_flag WHEN 'HIGH_CORR_WARNING' THEN ' (reduced from ' || format('{{:.1f}}%', position_pct) || ')' WHEN 'DIVERSIFIED' THEN ' (full size, diversified)' ELSE '' END END AS action FROM ch, pdl""")
def action_text(spark, sf):
    s, corr = _haircut(spark, sf)
    level = D.portfolio_vol_dd(s, corr).select("level").scalar()
    return s.withColumn("level", level).select("symbol", D.action_text().alias("action"))


# ------------------------------------------------------------------------- friction

PROX = V.CALENDAR + f""", hd AS (SELECT DISTINCT date AS e FROM calendar WHERE impact = 'HIGH'),
  px8 AS (SELECT CAST(unnest(generate_series(e - 7, e, INTERVAL 1 DAY)) AS DATE) AS date, e FROM hd), pn AS (SELECT date, min(e - date) AS d, max(CASE WHEN e - date = 1 THEN 1 ELSE 0 END) AS t FROM px8 GROUP BY 1),
  ep AS (SELECT w.date, p5 / 12500.0 AS vix, coalesce(d = 0, false) AS event_today, coalesce(t = 1, false) AS event_tomorrow, coalesce(d <= 2, false) AS event_48h, coalesce(d <= 7, false) AS event_7d FROM wide w LEFT JOIN pn ON w.date = pn.date)"""


def _prox(spark, sf):
    c = V.calendar(spark, sf).filter(F.col("impact") == "HIGH")
    days = V.wide(spark, sf).select("date", (F.col("p5") / 12500.0).alias("vix"))
    return D.event_proximity(days, c)


@query("fr_3_event_proximity", f"WITH {V.WIDE}, {PROX} SELECT date, event_today, event_tomorrow, event_48h, event_7d FROM ep")
def event_proximity(spark, sf):
    return _prox(spark, sf).drop("vix")


_SL = [map_sql("asset", {a: v[i] for a, v in D.SLIPPAGE.items()}) for i in (0, 1)]
FRI = f"""{V.WIDE}, {PROX}, fa AS (SELECT b.symbol, b.date, {map_sql('b.symbol', ROLE)} AS asset, vix, event_today, event_tomorrow FROM bars b JOIN ep ON b.date = ep.date),
  fr AS (SELECT *, CASE WHEN vix > 25 THEN {_SL[1]} ELSE {_SL[0]} END + CASE WHEN event_today OR event_tomorrow THEN {_SL[0]} * 0.5 ELSE 0.0 END AS slippage,
   CASE WHEN vix IS NOT NULL AND (event_today OR event_tomorrow) THEN greatest(CASE WHEN vix > 30 THEN 0.0025 WHEN vix > 20 THEN 0.0015 ELSE 0.0010 END, 0.0020)
    ELSE CASE WHEN vix > 30 THEN 0.0025 WHEN vix > 20 THEN 0.0015 ELSE 0.0010 END END::DOUBLE AS spread_cost FROM fa)"""


def _friction(spark, sf):
    b = V.bars(spark, sf).select("symbol", "date", map_label("symbol", ROLE).alias("asset"))
    return D.friction(b.join(_prox(spark, sf), "date"))


@query("fr_1_friction", f"WITH {FRI} SELECT symbol, date, round(slippage, 8) AS slippage, spread_cost, round(slippage + spread_cost, 8) AS friction FROM fr")
def friction(spark, sf):
    return _friction(spark, sf).select("symbol", "date", rnd("slippage", 8).alias("slippage"), "spread_cost", rnd("friction", 8).alias("friction"))


@query("fr_2_timing_quality", f"WITH {FRI} SELECT symbol, date, CASE WHEN vix > 30 AND (event_today OR event_tomorrow) THEN 'AVOID' WHEN slippage + spread_cost <= 0.0010 THEN 'GOOD_TIME' WHEN slippage + spread_cost <= 0.0020 THEN 'AVERAGE_TIME' ELSE 'POOR_TIME' END AS timing FROM fr")
def timing_quality(spark, sf):
    return _friction(spark, sf).select("symbol", "date", D.timing_quality().alias("timing"))
