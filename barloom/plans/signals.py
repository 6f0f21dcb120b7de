"""Signals (SG) and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.rolling import lag, pct_change
from barloom.functions.scalar import map_label
from barloom.operators import signals as G
from barloom.operators.align import upsample_ffill, upsample_linear
from barloom.operators.ranking import latest_per_key
from barloom.plans import views as V
from barloom.plans.registry import query
from barloom.plans.views import O, SIG, clip_sql, ladder_sql, map_sql, rnd, roll
from barloom.plans.windows import _norm_sql

MOM = V.BARS + ",\n " + V.mom_sql("bars")


def _mom(spark, sf):
    return G.momentum_score(V.bars(spark, sf).select("symbol", "date", "close"))


@query("flagship_latest_signal", f"""WITH {MOM}, l AS (SELECT symbol, date, close, score, close / lag(close) {O} - 1 AS ret,
  row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM mom)
  SELECT symbol, date, close, score, {SIG} AS signal, round(ret, 6) AS ret FROM l WHERE k = 1""")
def flagship(spark, sf):
    m = _mom(spark, sf).withColumns({"ret": rnd(pct_change("close")), "signal": G.score_to_signal("score")})
    return latest_per_key(m.select("symbol", "date", "close", "score", "signal", "ret"), ["symbol"])


@query("sg_1_momentum_score", f"WITH {MOM} SELECT symbol, date, score FROM mom")
def momentum_score(spark, sf):
    return _mom(spark, sf).select("symbol", "date", "score")


def rsi_sql(src: str, alpha: float, adjust: bool, need: int, name: str = "rsi") -> str:
    """CTE: RSI by the exact weights of the full recursion."""
    k = f"pow({1 - alpha}, CAST(a.rn - h.rn AS DOUBLE))"
    if adjust:
        avg = {v: f"sum(h.{v} * {k}) / sum({k})" for v in "gl"}
    else:
        avg = {v: f"sum(h.{v} * {k} * CASE WHEN h.rn = 1 THEN 1.0 ELSE {alpha} END)" for v in "gl"}
    return f"""{name}d AS (SELECT symbol, date, close - lag(close) {O} AS d FROM {src}),
  {name}n AS (SELECT symbol, date, CASE WHEN d > 0 THEN d ELSE 0.0 END AS g, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS l, row_number() {O} AS rn FROM {name}d WHERE d IS NOT NULL),
  {name}a AS (SELECT a.symbol, a.date, {avg['g']} AS ag, {avg['l']} AS al, count(*) AS c FROM {name}n a JOIN {name}n h ON a.symbol = h.symbol AND h.rn <= a.rn GROUP BY 1, 2),
  {name} AS (SELECT s.symbol, s.date, CASE WHEN c >= {need} THEN 100.0 - 100.0 / (1.0 + ag / (al + 1e-10)) END AS rsi FROM {src} s LEFT JOIN {name}a USING (symbol, date))"""


RSI_LADDER = ladder_sql("rsi", G.RSI_STEPS, 1.0, 1.0)


@query("sg_2_rsi", f"WITH {V.BARS}, {rsi_sql('bars', 2 / 15, False, 1)} SELECT symbol, date, round(rsi, 4) AS rsi, {RSI_LADDER} AS rsi_score FROM rsi")
def rsi(spark, sf):
    r = G.rsi(V.bars(spark, sf).select("symbol", "date", "close"))
    return r.select("symbol", "date", rnd("rsi", 4).alias("rsi"), G.rsi_score().alias("rsi_score"))


@query("sg_3_rsi_wilder", f"WITH {V.BARS}, {rsi_sql('bars', 1 / 14, True, 14)} SELECT symbol, date, round(rsi, 4) AS rsi FROM rsi")
def rsi_wilder(spark, sf):
    r = G.rsi_wilder(V.bars(spark, sf).select("symbol", "date", "close"), 14)
    return r.select("symbol", "date", rnd("rsi", 4).alias("rsi"))


ROC = f"rc0 AS (SELECT symbol, date, (close / lag(close, 10) {O} - 1) * 100.0 AS roc FROM bars), rc AS (SELECT symbol, date, {_norm_sql('roc')} AS roc_score FROM rc0)"


@query("sg_4_roc_score", f"WITH {V.BARS}, {ROC} SELECT symbol, date, round(roc_score, 6) AS roc_score FROM rc")
def roc_score(spark, sf):
    r = G.roc_score(V.bars(spark, sf).select("symbol", "date", "close"))
    return r.select("symbol", "date", rnd("roc_score").alias("roc_score"))


VOLF = ladder_sql("p5 / 12500.0", [("<", 20.0, 0.5), ("<", 30.0, 0.0)], -1.0, -1.0)


@query("sg_5_vol_filter", f"WITH {V.WIDE} SELECT date, {VOLF} AS vol, -({VOLF}) * 0.5 AS vol_gold FROM wide")
def vol_filter(spark, sf):
    v = G.vol_filter(F.col("p5") / 12500.0)
    return V.wide(spark, sf).select("date", v.alias("vol"), (-v * 0.5).alias("vol_gold"))


CLASSES = ("equity", "gold", "crude")
YOY = V.MACRO + ", yoy AS (SELECT *, (cpi_index / lag(cpi_index, 12) OVER (ORDER BY date) - 1) * 100.0 AS cpi_yoy FROM macro)"
_DAYS = "unnest(generate_series(date, CASE WHEN nxt IS NULL THEN date ELSE nxt - 1 END, INTERVAL 1 DAY))"


def quad_sql(c: str) -> str:
    a, b, x, d = G.QUADRANT_SCORES[c]
    return (f"CAST(CASE WHEN NOT cpi > 3.0 AND gr > 0 THEN {a} WHEN cpi > 3.0 AND gr > 0 THEN {b} WHEN cpi > 3.0 THEN {x} ELSE {d} END AS DOUBLE)")


MACRO_DAILY = YOY + f""", md0 AS (SELECT date, cpi_yoy, growth, lead(date) OVER o AS nxt, lead(cpi_yoy) OVER o AS ncpi, lead(growth) OVER o AS ngr FROM yoy WHERE cpi_yoy IS NOT NULL WINDOW o AS (ORDER BY date)),
  md1 AS (SELECT *, CAST({_DAYS} AS DATE) AS day FROM md0),
  md AS (SELECT day AS date, CASE WHEN nxt IS NULL THEN cpi_yoy ELSE cpi_yoy + (ncpi - cpi_yoy) * (day - date) / (nxt - date) END AS cpi,
   CASE WHEN nxt IS NULL THEN growth ELSE growth + (ngr - growth) * (day - date) / (nxt - date) END AS gr FROM md1 WHERE isodow(day) < 6),
  mq AS (SELECT date, {', '.join(f'{quad_sql(c)} AS macro_{c}' for c in CLASSES)} FROM md)"""


def _macro_daily(spark, sf):
    m = V.macro(spark, sf)
    yoy = m.withColumn("cpi_yoy", pct_change("cpi_index", 12, by=()) * 100.0).na.drop(subset=["cpi_yoy"])
    d = upsample_linear(yoy.select("date", "cpi_yoy", "growth"), ["cpi_yoy", "growth"], by=())
    d = d.filter(F.weekday("date") < 5)
    return d.select("date", *[G.macro_quadrant_score("cpi_yoy", "growth", c).alias(f"macro_{c}") for c in CLASSES])


@query("sg_6_macro_quadrant_score", f"WITH {MACRO_DAILY} SELECT * FROM mq")
def macro_quadrant(spark, sf):
    return _macro_daily(spark, sf)


def curve_case(c: str) -> str:
    steps, default = G.CURVE_STEPS[c]
    return ladder_sql("spread", steps, default)


CURVE_DAILY = f""", cu0 AS (SELECT date, y10 - y2 AS spread, lead(date) OVER (ORDER BY date) AS nxt FROM macro),
  cu1 AS (SELECT spread, CAST({_DAYS} AS DATE) AS day FROM cu0),
  cu AS (SELECT day AS date, {', '.join(f'{curve_case(c)} AS curve_{c}' for c in CLASSES)} FROM cu1 WHERE isodow(day) < 6)"""


def _curve_daily(spark, sf):
    s = V.macro(spark, sf).select("date", (F.col("y10") - F.col("y2")).alias("spread"))
    d = upsample_ffill(s, by=()).filter(F.weekday("date") < 5)
    return d.select("date", *[G.curve_score("spread", c).alias(f"curve_{c}") for c in CLASSES])


@query("sg_7_curve_score", f"WITH {V.MACRO} {CURVE_DAILY} SELECT * FROM cu")
def curve_score(spark, sf):
    return _curve_daily(spark, sf)


FX = f", fx0 AS (SELECT date, p2 / lag(p2, 20) OVER (ORDER BY date) - 1 AS m FROM wide WHERE p2 IS NOT NULL), fx AS (SELECT date, -({_norm_sql('m', by=None)}) AS fx_score FROM fx0)"
# the dollar index is a series of its own; headlines of the day of the month stand for the day's sentiment
DOLLAR = f""", dx0 AS (SELECT date, p1 / lag(p1, 20) OVER (ORDER BY date) - 1 AS m FROM wide WHERE p1 IS NOT NULL), dx AS (SELECT date, -({_norm_sql('m', by=None)}) AS fx_score FROM dx0),
  {V.HEADLINES}, sn AS (SELECT CAST(day(date) AS INTEGER) AS dom, avg(base_score) AS sentiment FROM headlines GROUP BY 1)"""


def _fx(spark, sf, symbol="2-HIGH", out="fx_score"):
    w = V.bars(spark, sf).filter(F.col("symbol") == symbol).select("date", F.col("close").alias("p2"))
    return G.fx_score(w, "p2").select("date", F.col("fx_score").alias(out))


def _sentiment(spark, sf):
    return V.headlines(spark, sf).groupBy(F.dayofmonth("date").alias("_dom")).agg(F.avg("base_score").alias("sentiment"))


@query("sg_8_fx_score", f"WITH {V.WIDE} {FX} SELECT date, round(fx_score, 6) AS fx_score FROM fx")
def fx_score(spark, sf):
    return _fx(spark, sf).withColumn("fx_score", rnd("fx_score"))


@query("sg_9_sentiment_score", f"WITH {V.HEADLINES} SELECT doc_id, " + ", ".join(
    f"round({clip_sql(f'base_score * {k}', -1.0, 1.0)}, 6) AS {c}" for c, k in G.SENTIMENT_FACTOR.items()) + " FROM headlines")
def sentiment_score(spark, sf):
    return V.headlines(spark, sf).select("doc_id", *[rnd(G.sentiment_score("base_score", c)).alias(c) for c in CLASSES])


ROLE = dict(zip(V.SYMBOLS, G.ASSET_WEIGHTS))


def _pick(prefix: str) -> str:
    return "CASE " + " ".join(f"WHEN b.symbol = '{s}' THEN {prefix}_{G.ASSET_CLASS[a]}" for s, a in ROLE.items()) + " END"


def _fill(c: str) -> str:
    return (f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), "
            f"first_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}")


def _wt(i: int) -> str:
    return map_sql("symbol", {s: G.ASSET_WEIGHTS[a][i] for s, a in ROLE.items()}, 0.0)


_SENT = "CASE " + " ".join(f"WHEN symbol = '{s}' THEN coalesce({clip_sql('sentiment * ' + f, -1.0, 1.0)}, 0.0)" for s, f in (
    (s, {"NIFTY": "2.0", "SP500": "2.0", "Gold": "-1.5"}.get(a)) for s, a in ROLE.items()) if f) + " ELSE 0.0 END"
COMPOSITE = f"""{V.WIDE}, {V.mom_sql('bars')}, {rsi_sql('bars', 2 / 15, False, 1)}, {ROC}, {MACRO_DAILY.replace('macro AS', 'macro AS', 1)} {CURVE_DAILY} {FX} {DOLLAR},
  vx AS (SELECT date, {VOLF} AS vol FROM wide WHERE p5 IS NOT NULL),
  cp AS (SELECT b.symbol, b.date, b.close, mom.score AS ma, {RSI_LADDER} AS rsi_s, rc.roc_score AS roc,
   CASE WHEN b.symbol IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN -vol * 0.5 ELSE vol END AS vol, {_pick('macro')} AS macro, {_pick('curve')} AS curve,
   CASE WHEN b.symbol = {repr(next(s for s, a in ROLE.items() if a == 'NIFTY'))} THEN fx.fx_score ELSE dx.fx_score END * {map_sql('b.symbol', {s: G.FX_FACTOR[a] for s, a in ROLE.items()})} AS fx, sentiment
   FROM bars b JOIN mom USING (symbol, date) JOIN rsi USING (symbol, date) JOIN rc USING (symbol, date)
   LEFT JOIN vx ON b.date = vx.date LEFT JOIN mq ON b.date = mq.date LEFT JOIN cu ON b.date = cu.date LEFT JOIN fx ON b.date = fx.date LEFT JOIN dx ON b.date = dx.date LEFT JOIN sn ON day(b.date) = dom),
  cf AS (SELECT symbol, date, close, sentiment, {', '.join(_fill(c) for c in G.COMPONENTS)} FROM cp),
  c0 AS (SELECT symbol, date, close, sentiment, {clip_sql('(' + ' + '.join(f'{c} * {_wt(i)}' for i, c in enumerate(G.COMPONENTS)) + ') / (' + ' + '.join(_wt(i) for i in range(7)) + ')', -1.0, 1.0)} AS score FROM cf),
  cs AS (SELECT symbol, date, close, {clip_sql('score + 0.05 * ' + _SENT, -1.0, 1.0)} AS score FROM c0)"""


def components(spark, sf):
    b = V.bars(spark, sf).select("symbol", "date", "close")
    ts = G.roc_score(G.rsi(G.momentum_score(b)))
    vix = V.bars(spark, sf).filter("symbol = '5-LOW'").select("date", G.vol_filter(F.col("close") / 12500.0).alias("_vol"))
    j = ts.join(vix, "date", "left").join(_macro_daily(spark, sf), "date", "left")
    j = j.join(_curve_daily(spark, sf), "date", "left").join(_fx(spark, sf), "date", "left")
    j = j.join(_fx(spark, sf, "1-URGENT", "dollar_score"), "date", "left")
    j = j.withColumn("_dom", F.dayofmonth("date")).join(_sentiment(spark, sf), "_dom", "left")
    j = j.withColumn("asset", map_label("symbol", ROLE)).withColumn("asset_class", map_label("asset", G.ASSET_CLASS))
    return j.select(
        "symbol", "asset", "date", "close", F.col("score").alias("ma"), G.rsi_score().alias("rsi_s"),
        F.col("roc_score").alias("roc"),
        F.when(F.col("asset_class") == "gold", -F.col("_vol") * 0.5).otherwise(F.col("_vol")).alias("vol"),
        G.by_class({c: f"macro_{c}" for c in CLASSES}).alias("macro"),
        G.by_class({c: f"curve_{c}" for c in CLASSES}).alias("curve"),
        (F.when(F.col("asset") == "NIFTY", F.col("fx_score")).otherwise(F.col("dollar_score")) * map_label("asset", G.FX_FACTOR)).alias("fx"), "sentiment")


@query("sg_10_composite", f"WITH {COMPOSITE} SELECT symbol, date, round(score, 6) AS score FROM cs")
def composite(spark, sf):
    return G.asset_composite(components(spark, sf), sentiment="sentiment").select("symbol", "date", rnd("score").alias("score"))


CONF = ladder_sql("abs(score)", G.CONVICTION_STEPS, "NONE", "NONE")


@query("sg_11_score_to_signal", f"WITH {MOM} SELECT symbol, date, {SIG} AS signal, {CONF} AS confidence, CASE WHEN abs(score) >= 0.5 THEN 'HIGH' WHEN abs(score) >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS conviction FROM mom")
def score_to_signal(spark, sf):
    return _mom(spark, sf).select("symbol", "date", G.score_to_signal("score").alias("signal"),
                                  G.confidence("score").alias("confidence"), G.conviction("score").alias("conviction"))


STABLE = f"""sg AS (SELECT symbol, date, close, score, {SIG} AS signal, {CONF} AS confidence, row_number() {O} AS rn FROM mom),
  sa AS (SELECT *, CASE WHEN rn <= 3 OR (signal = lag(signal, 1) {O} AND signal = lag(signal, 2) {O}) THEN signal END AS a FROM sg),
  ss AS (SELECT *, last_value(a IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS stable FROM sa)"""


def signals(spark, sf):
    m = _mom(spark, sf).withColumns({"signal": G.score_to_signal("score"), "confidence": G.confidence("score")})
    return G.stable_signal(m)


@query("sg_12_stable_signal", f"WITH {MOM}, {STABLE} SELECT symbol, date, signal, stable FROM ss")
def stable_signal(spark, sf):
    return signals(spark, sf).select("symbol", "date", "signal", "stable")


def hit_sql(src: str, name: str = "hr") -> str:
    return f"""{name}d AS (SELECT symbol, date, CASE WHEN score >= 0.15 THEN 1 WHEN score <= -0.15 THEN -1 ELSE 0 END AS dir,
   sign(close / lag(close) {O} - 1) AS sg, row_number() {O} AS rn FROM {src}),
  {name}h AS (SELECT *, CASE WHEN lag(dir) {O} <> 0 AND lag(dir) {O} = sg THEN 1 ELSE 0 END AS hit FROM {name}d),
  {name}s AS (SELECT *, sum(hit) {V.w(59)} AS hits, sum(abs(dir)) {V.w(60)} AS act FROM {name}h),
  {name} AS (SELECT symbol, date, CASE WHEN rn >= 60 AND act > 0 THEN CAST(hits AS DOUBLE) / act ELSE 0.5 END AS hit_rate FROM {name}s)"""


@query("sg_13_hit_rate", f"WITH {MOM}, {hit_sql('mom')} SELECT symbol, date, round(hit_rate, 6) AS hit_rate FROM hr")
def hit_rate(spark, sf):
    return G.hit_rate(_mom(spark, sf)).select("symbol", "date", rnd("hit_rate").alias("hit_rate"))


@query("sg_13b_actionable", f"WITH {MOM}, {STABLE} SELECT symbol, date, signal, confidence FROM ss WHERE signal <> 'Neutral' AND stable = signal AND confidence IN ('HIGH', 'MEDIUM')")
def actionable(spark, sf):
    return G.actionable(signals(spark, sf)).select("symbol", "date", "signal", "confidence")


@query("sg_14_legacy_ma_vix_signal", f"""WITH {V.WIDE}, m AS (SELECT b.symbol, b.date, close, p5 / 12500.0 AS vix FROM bars b JOIN wide w ON b.date = w.date),
  a AS (SELECT *, {roll('avg', 'close', 20)} AS a, {roll('avg', 'close', 60)} AS b FROM m)
  SELECT symbol, date, CASE WHEN close > a AND a > b AND vix < 25 THEN 'Long' WHEN (close < a AND a < b) OR vix > 30 THEN 'Short' ELSE 'Neutral' END AS signal FROM a""")
def legacy_signal(spark, sf):
    b = V.bars(spark, sf)
    vix = b.filter("symbol = '5-LOW'").select("date", (F.col("close") / 12500.0).alias("vix"))
    return G.legacy_signal(b.select("symbol", "date", "close").join(vix, "date", "left")).select("symbol", "date", "signal")


def _mtf_sql() -> str:
    out = [V.BARS, "weekly AS (SELECT symbol, CAST(date_trunc('week', date) AS DATE) + 6 AS date, arg_max(close, date) AS close FROM bars GROUP BY 1, 2)",
           "monthly AS (SELECT symbol, last_day(date) AS date, arg_max(close, date) AS close FROM bars GROUP BY 1, 2)"]
    for tf, (fast, slow, trend, n) in G.TIMEFRAMES.items():
        src = "bars" if tf == "daily" else tf
        out.append(rsi_sql(src, 1 / n, True, n, f"r_{tf}"))
        out.append(f"""t_{tf} AS (SELECT s.symbol, s.date, close, rsi, {roll('avg', 'close', fast)} AS f, {roll('avg', 'close', slow)} AS sl, {roll('avg', 'close', trend)} AS t,
          row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM {src} s JOIN r_{tf} USING (symbol, date))""")
    sel = " UNION ALL ".join(f"""SELECT symbol, '{tf}' AS timeframe, date, CASE WHEN rn >= {p[2] + 5} AND t IS NOT NULL AND rsi IS NOT NULL THEN CAST(
      CASE WHEN close > f THEN 0.25 ELSE -0.25 END + CASE WHEN f > sl THEN 0.25 ELSE -0.25 END + CASE WHEN sl > t THEN 0.25 ELSE -0.25 END
      + CASE WHEN rsi > 60 THEN 0.25 WHEN rsi < 40 THEN -0.25 ELSE 0 END AS DOUBLE) END AS score FROM t_{tf}""" for tf, p in G.TIMEFRAMES.items())
    out.append(f"mt0 AS ({sel})")
    out.append(f"mt AS (SELECT *, {ladder_sql('score', [('>=', 0.2, 'LONG'), ('<=', -0.2, 'SHORT')], 'NEUTRAL', 'NEUTRAL')} AS direction FROM mt0)")
    return ", ".join(out)


MTF = _mtf_sql()


@query("sg_15_mtf_score", f"WITH {MTF} SELECT symbol, timeframe, date, score, direction FROM mt")
def mtf_score(spark, sf):
    return G.mtf_scores(V.bars(spark, sf)).drop("rsi")


@query("sg_16_mtf_confirm", f"""WITH {MTF}, p AS (SELECT symbol, """ + ", ".join(
    f"arg_max(direction, date) FILTER (timeframe = '{t}') AS {t[0]}" for t in G.TIMEFRAMES) + """ FROM mt GROUP BY 1),
  s AS (SELECT *, CASE WHEN (d = 'SHORT' AND m = 'LONG') OR (d = 'LONG' AND m = 'SHORT') THEN 'CONFLICTED'
   WHEN d = w AND w = m AND d <> 'NEUTRAL' THEN 'THREE_WAY_CONFIRMED'
   WHEN len(list_filter([d, w, m], lambda x: x = 'LONG')) >= 2 OR len(list_filter([d, w, m], lambda x: x = 'SHORT')) >= 2 THEN 'TWO_WAY_CONFIRMED'
   WHEN d = 'NEUTRAL' AND w = 'NEUTRAL' AND m = 'NEUTRAL' THEN 'NEUTRAL' ELSE 'CONFLICTED' END AS status FROM p)
  SELECT symbol, d AS daily, w AS weekly, m AS monthly, status, CASE WHEN status IN ('THREE_WAY_CONFIRMED', 'TWO_WAY_CONFIRMED') THEN
   CASE WHEN len(list_filter([d, w, m], lambda x: x = 'LONG')) > len(list_filter([d, w, m], lambda x: x = 'SHORT')) THEN 'LONG' ELSE 'SHORT' END ELSE 'NO TRADE' END AS overall FROM s""")
def mtf_confirm(spark, sf):
    m = G.mtf_scores(V.bars(spark, sf))
    p = m.groupBy("symbol").agg(*[
        F.max_by("direction", F.when(F.col("timeframe") == t, F.col("date"))).alias(t) for t in G.TIMEFRAMES])
    status, overall = G.mtf_confirm()
    return p.withColumns({"status": status, "overall": overall})
