"""Option chain, positioning, flows, basis, gaps and calendar (OP, PO, FL, BS, GP, EC)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.rolling import row_no, trend_slope
from barloom.functions.scalar import ladder, map_label
from barloom.operators import flows as FL
from barloom.operators import market as M
from barloom.operators import options as OC
from barloom.plans import views as V
from barloom.plans.registry import query
from barloom.plans.regimes import REGH, regime_history
from barloom.plans.views import ladder_sql, map_sql, rnd, roll
from barloom.sources.sinks import upsert

N = {"by": None}
SPOT = 250.0

PCR = V.OPTIONS + """, pc0 AS (SELECT expiry, sum(CASE WHEN opt_type = 'CE' THEN oi ELSE 0 END) AS ce_oi, sum(CASE WHEN opt_type = 'PE' THEN oi ELSE 0 END) AS pe_oi,
  sum(CASE WHEN opt_type = 'CE' THEN vol ELSE 0 END) AS ce_vol, sum(CASE WHEN opt_type = 'PE' THEN vol ELSE 0 END) AS pe_vol FROM options GROUP BY 1),
  pc AS (SELECT *, coalesce(pe_oi / nullif(ce_oi, 0), 0) AS pcr_oi, coalesce(pe_vol / nullif(ce_vol, 0), 0) AS pcr_vol FROM pc0)"""


@query("opt_1_pcr", f"""WITH {PCR} SELECT expiry, ce_oi, pe_oi, round(pcr_oi, 6) AS pcr_oi, round(pcr_vol, 6) AS pcr_vol, {ladder_sql('pcr_oi', OC.PCR_NEAR_STEPS, 'NEUTRAL', 'UNKNOWN')} AS label,
  {ladder_sql('pcr_oi', OC.PCR_ALL_STEPS, 'NEUTRAL', 'UNKNOWN')} AS label_all FROM pc""")
def pcr(spark, sf):
    p = OC.pcr(V.options(spark, sf))
    return p.select("expiry", "ce_oi", "pe_oi", rnd("pcr_oi").alias("pcr_oi"), rnd("pcr_vol").alias("pcr_vol"),
                    OC.pcr_label("pcr_oi").alias("label"), OC.pcr_label("pcr_oi", OC.PCR_ALL_STEPS).alias("label_all"))


PAIN = """st AS (SELECT DISTINCT expiry, strike FROM options), pa AS (SELECT st.expiry, st.strike, sum(CASE WHEN o.opt_type = 'CE' AND o.strike < st.strike THEN (st.strike - o.strike) * o.oi
    WHEN o.opt_type = 'PE' AND o.strike > st.strike THEN (o.strike - st.strike) * o.oi ELSE 0.0 END) AS pain FROM st JOIN options o USING (expiry) GROUP BY 1, 2),
  mp AS (SELECT expiry, strike AS max_pain_strike, pain, (strike - 250.0) / 250.0 * 100 AS deviation_pct FROM pa QUALIFY row_number() OVER (PARTITION BY expiry ORDER BY pain, strike) = 1),
  mb AS (SELECT *, CASE WHEN abs(deviation_pct) < 1.5 THEN 'NEUTRAL' WHEN deviation_pct > 3 THEN 'BULLISH_GRAVITATE' WHEN deviation_pct < -3 THEN 'BEARISH_GRAVITATE' WHEN deviation_pct > 0 THEN 'MILDLY_BULLISH' ELSE 'MILDLY_BEARISH' END AS bias FROM mp)"""


@query("opt_2_max_pain", f"WITH {V.OPTIONS}, {PAIN} SELECT expiry, max_pain_strike, round(pain, 2) AS pain, round(deviation_pct, 4) AS deviation_pct, bias FROM mb")
def max_pain(spark, sf):
    return OC.max_pain(V.options(spark, sf), SPOT).withColumns({"pain": rnd("pain", 2), "deviation_pct": rnd("deviation_pct", 4)})


SKEW = """sk0 AS (SELECT expiry, avg(price) FILTER (opt_type = 'PE' AND strike >= 200 AND strike < 250) AS ap, avg(price) FILTER (opt_type = 'CE' AND strike <= 300 AND strike > 250) AS ac FROM options GROUP BY 1),
  sk AS (SELECT *, ap / nullif(ac, 0) AS skew_ratio, CASE WHEN ap IS NULL OR ac IS NULL THEN 'INSUFFICIENT_STRIKES' WHEN ac = 0 THEN 'UNAVAILABLE' WHEN ap / ac >= 1.2 THEN 'ELEVATED_PUT_DEMAND' WHEN ap / ac <= 0.8 THEN 'ELEVATED_CALL_DEMAND' ELSE 'BALANCED' END AS skew_signal FROM sk0)"""


def _priced(spark, sf):
    """Options whose close is missing at every third strike, where the last price stands in."""
    third = F.col("strike") % 30 == 0
    return V.options(spark, sf).withColumns({"close_px": F.when(~third, F.col("price")), "last_px": F.when(third, F.col("price")).otherwise(0.0)})


@query("opt_3_skew_ratio", f"WITH {V.OPTIONS}, {SKEW} SELECT expiry, round(skew_ratio, 6) AS skew_ratio, skew_signal FROM sk")
def skew_ratio(spark, sf):
    return OC.skew_ratio(_priced(spark, sf), SPOT, width_pct=20.0).select("expiry", rnd("skew_ratio").alias("skew_ratio"), "skew_signal")


TERM = V.WIDE + f""", v0 AS (SELECT date, p5 / 12500.0 AS vix FROM wide WHERE p5 IS NOT NULL), v1 AS (SELECT *, {roll('avg', 'vix', 30, **N)} AS far, {roll('stddev_samp', 'vix', 30, **N)} AS sd FROM v0),
  vt AS (SELECT date, vix, CASE WHEN vix > 0 THEN far / vix END AS ts_ratio, CASE WHEN sd > 0 THEN (vix - far) / sd WHEN sd IS NOT NULL THEN 0.0 END AS iv_zscore, {ladder_sql('vix', OC.IV_STEPS, 'COMPRESSED')} AS iv_regime FROM v1)"""


def _term(spark, sf):
    v = V.bars(spark, sf).filter("symbol = '5-LOW'").select("date", (F.col("close") / 12500.0).alias("vix"))
    return M.vol_term_structure(v, "vix")


@query("opt_4_vol_term_structure", f"WITH {TERM} SELECT date, round(ts_ratio, 6) AS ts_ratio, round(iv_zscore, 6) AS iv_zscore, iv_regime, {ladder_sql('ts_ratio', [('>=', 1.05, 'CONTANGO'), ('<=', 0.95, 'BACKWARDATION')], 'FLAT', 'UNAVAILABLE')} AS ts_signal FROM vt")
def vol_term_structure(spark, sf):
    return _term(spark, sf).select("date", rnd("ts_ratio").alias("ts_ratio"), rnd("iv_zscore").alias("iv_zscore"), "iv_regime", "ts_signal")


OPTC = f"""{PCR}, {PAIN}, {SKEW}, cm AS (SELECT expiry, round({V.clip_sql(' + '.join([map_sql(ladder_sql('pcr_oi', OC.PCR_NEAR_STEPS, 'NEUTRAL', 'UNKNOWN'), OC.PCR_SCORE, 0.0), map_sql('bias', OC.PAIN_SCORE, 0.0), map_sql('skew_signal', OC.SKEW_SCORE, 0.0), map_sql(ladder_sql('pcr_vol * 20', OC.IV_STEPS, 'COMPRESSED'), OC.IV_SCORE, 0.0)]), -1.0, 1.0)}, 4) AS composite FROM pc JOIN mb USING (expiry) JOIN sk USING (expiry))"""


def _composite(spark, sf):
    o = V.options(spark, sf)
    j = OC.pcr(o).join(OC.max_pain(o, SPOT), "expiry").join(OC.skew_ratio(o, SPOT, 20.0, "price"), "expiry")
    j = j.withColumns({"pcr_signal": OC.pcr_label("pcr_oi"), "iv_regime": ladder(F.col("pcr_vol") * 20, OC.IV_STEPS, "COMPRESSED")})
    return OC.options_composite(j)


@query("opt_5_options_composite", f"WITH {OPTC} SELECT expiry, composite, {ladder_sql('composite', OC.COMPOSITE_STEPS, 'NEUTRAL')} AS signal FROM cm")
def options_composite(spark, sf):
    return _composite(spark, sf).select("expiry", "composite", F.col("composite_signal").alias("signal"))


@query("wn_25_options_score_trend", f"""WITH {OPTC}, cn AS (SELECT expiry, composite, CAST(row_number() OVER (ORDER BY expiry) AS DOUBLE) AS rn FROM cm), cs AS (SELECT expiry, CASE WHEN count(*) OVER f >= 5 THEN round(regr_slope(composite, rn) OVER f, 9) END AS s FROM cn WINDOW f AS (ORDER BY expiry ROWS 4 PRECEDING))
  SELECT expiry, round(s, 6) AS slope, CASE WHEN s > 0.01 THEN 'IMPROVING' WHEN s < -0.01 THEN 'DETERIORATING' ELSE 'STABLE' END AS trend FROM cs""")
def options_score_trend(spark, sf):
    c = _composite(spark, sf).select("expiry", "composite").withColumn("rn", row_no(by=(), order="expiry"))
    c = c.withColumn("slope", rnd(trend_slope("composite", 5, by=(), order="expiry"), 9))
    return c.select("expiry", rnd("slope").alias("slope"), ladder("slope", [(">", 0.01, "IMPROVING"), ("<", -0.01, "DETERIORATING")], "STABLE", "STABLE").alias("trend"))


@query("opt_6_nearest_expiry", f"WITH {V.OPTIONS} SELECT expiry, strike, opt_type, oi FROM options WHERE expiry = (SELECT min(expiry) FROM options)")
def nearest_expiry(spark, sf):
    return OC.nearest_expiry(V.options(spark, sf)).select("expiry", "strike", "opt_type", "oi")


@query("po_1_cot_percentile", f"""WITH {V.POSITIONS}, n AS (SELECT contract, date, "long" - "short" AS net FROM positions), m AS (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY date) AS rn FROM n),
  p AS (SELECT a.contract, a.date, a.net, CAST(count(*) FILTER (h.net <= a.net) AS DOUBLE) / count(*) * 100 AS pct FROM m a JOIN m h ON h.contract = a.contract AND h.rn BETWEEN a.rn - 519 AND a.rn GROUP BY 1, 2, 3)
  SELECT contract, date, net, round(pct, 6) AS pct, {ladder_sql('pct', FL.COT_STEPS, 'NEUTRAL')} AS signal FROM p""")
def cot_percentile(spark, sf):
    return FL.cot_percentile(V.positions(spark, sf)).select("contract", "date", "net", rnd("pct").alias("pct"), "signal")


@query("fl_1_flow_streak_signal", f"""WITH {V.FLOWS}, s AS (SELECT date, net, net >= 0 AS up, lag(net >= 0) OVER (ORDER BY date) AS pu FROM flows), i AS (SELECT *, sum(CASE WHEN pu IS NULL OR pu <> up THEN 1 ELSE 0 END) OVER (ORDER BY date) AS isl FROM s),
  k AS (SELECT *, row_number() OVER (PARTITION BY isl ORDER BY date) AS n FROM i)
  SELECT date, CASE WHEN n >= 5 THEN CASE WHEN up THEN 'BULLISH' ELSE 'BEARISH' END WHEN n >= 3 THEN CASE WHEN up THEN 'MILD_BULLISH' ELSE 'MILD_BEARISH' END WHEN net < -5000 THEN 'WEAK_BEARISH' WHEN net > 5000 THEN 'WEAK_BULLISH' ELSE 'NEUTRAL' END AS flow_signal FROM k""")
def flow_streak_signal(spark, sf):
    return FL.streak_signal(FL.streaks(V.flows(spark, sf))).select("date", "flow_signal")


@query("fl_2_flow_regime_combo", f"""WITH {REGH}, {V.FLOWS}, fm AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, sum(net) AS net FROM flows GROUP BY 1),
  j AS (SELECT rh.date, regional, CASE WHEN net > 0 THEN 'BUY' WHEN net < 0 THEN 'SELL' ELSE 'NEUTRAL' END AS dir FROM rh JOIN fm ON rh.date = fm.date),
  k AS (SELECT date, CASE WHEN regional = 'INDIA_GOLDILOCKS' THEN regional || '_FII_' || dir WHEN regional IN ('INDIA_STAGFLATION', 'INDIA_OVERHEATING', 'INDIA_SLOWDOWN') THEN regional ELSE 'INDIA_OVERHEATING' END AS signal_key FROM j)
  SELECT date, signal_key, {map_sql('signal_key', FL.FLOW_ADJUST, 0.0)} AS adjustment FROM k""")
def flow_regime_combo(spark, sf):
    f = V.flows(spark, sf).groupBy(F.trunc("date", "month").alias("date")).agg(F.sum("net").alias("net"))
    j = regime_history(spark, sf).select("date", F.col("regional").alias("regime")).join(f, "date")
    return FL.flow_regime_combo(j).select("date", "signal_key", "adjustment")


@query("bs_1_futures_basis", f"""WITH {V.WIN}, b0 AS (SELECT date, (p3 - p4) / 10000 AS basis, row_number() OVER (ORDER BY date) AS rn FROM win),
  b AS (SELECT a.date, a.basis, CAST(count(*) FILTER (h.basis <= a.basis) AS DOUBLE) / count(*) * 100 AS basis_pct FROM b0 a JOIN b0 h ON h.rn BETWEEN a.rn - 1259 AND a.rn GROUP BY 1, 2), s AS (SELECT *, CASE WHEN basis > 0 THEN 'BACKWARDATION' WHEN basis + 8 > 0.5 THEN 'MILD_BACKWARDATION' WHEN basis + 8 < -2.5 THEN 'DEEP_CONTANGO' WHEN basis + 8 < -0.5 THEN 'CONTANGO' ELSE 'NORMAL' END AS status,
  ({roll('avg', 'basis', 5, **N)}) - ({roll('avg', 'basis', 5, skip=5, **N)}) AS c FROM b)
  SELECT date, round(basis, 6) AS basis, status, round(basis_pct, 4) AS basis_pct, {map_sql('status', M.BASIS_ADJUST, 0.0)} AS adj_long, -({map_sql('status', M.BASIS_ADJUST, 0.0)}) AS adj_short,
  {ladder_sql('c', [('>', 0.5, 'IMPROVING'), ('<', -0.5, 'DETERIORATING')], 'STABLE', 'UNKNOWN')} AS trend FROM s""")
def futures_basis(spark, sf):
    w = V.wide_inner(spark, sf).select("date", (F.col("p3") / 10000).alias("f"), (F.col("p4") / 10000).alias("s"))
    d = M.futures_basis(w, "f", "s", -8.0)
    return d.select("date", rnd("basis").alias("basis"), "status", rnd("basis_pct", 4).alias("basis_pct"), "adj_long", "adj_short", "trend")


# ------------------------------------------------------------------------- gaps

# The bar path scaled so that overnight gaps are of everyday size.
GBARS = V.BARS + """, gb AS (SELECT symbol, date, 1000 + open / 50000 AS open, 1000 + high / 50000 AS high, 1000 + low / 50000 AS low, 1000 + close / 50000 AS close, volume FROM bars)"""
GAPS = GBARS + f""", g0 AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS prev_close FROM gb),
  g1 AS (SELECT *, open - prev_close AS gap_points, (open - prev_close) / prev_close * 100 AS gap_pct FROM g0 WHERE prev_close IS NOT NULL),
  gp AS (SELECT *, CASE WHEN gap_pct >= 0 THEN 'UP' ELSE 'DOWN' END AS direction, {ladder_sql('abs(gap_pct)', M.GAP_STEPS, 'EXTREME')} AS gap_size FROM g1)"""
FILL = """f0 AS (SELECT *, CASE direction WHEN 'UP' THEN low <= prev_close ELSE high >= prev_close END AS f, CASE direction WHEN 'UP' THEN 1 ELSE -1 END * (close - open) / open * 100 AS c FROM gp WHERE abs(gap_pct) > 0.05),
  fs AS (SELECT symbol, gap_size, CAST(count(*) AS BIGINT) AS n, avg(CASE WHEN f THEN 1.0 ELSE 0.0 END) AS fill_rate, coalesce(avg(c) FILTER (NOT f), 0) AS avg_cont FROM f0 GROUP BY 1, 2 HAVING count(*) >= 5)"""


def _gaps(spark, sf):
    b = V.bars(spark, sf)
    return M.gap_detect(b.withColumns({c: 1000 + F.col(c) / 50000 for c in ("open", "high", "low", "close")}))


@query("gp_1_gap_detect", f"WITH {GAPS} SELECT symbol, date, round(gap_points, 6) AS gap_points, round(gap_pct, 6) AS gap_pct, direction, gap_size FROM gp")
def gap_detect(spark, sf):
    return _gaps(spark, sf).select("symbol", "date", rnd("gap_points").alias("gap_points"), rnd("gap_pct").alias("gap_pct"), "direction", "gap_size")


@query("gp_2_gap_fill_stats", f"WITH {GAPS}, {FILL} SELECT symbol, gap_size, n, round(fill_rate, 6) AS fill_rate, round(avg_cont, 6) AS avg_cont FROM fs")
def gap_fill_stats(spark, sf):
    s = M.gap_fill_stats(_gaps(spark, sf), ("symbol", "gap_size"))
    return s.withColumns({"fill_rate": rnd("fill_rate"), "avg_cont": rnd("avg_cont")})


GSC = f"""{GAPS}, gpf AS (SELECT *, CASE WHEN count(f) OVER b >= 5 THEN avg(f) OVER b END AS fill_rate
   FROM (SELECT *, CASE WHEN abs(gap_pct) > 0.05 THEN CASE WHEN CASE direction WHEN 'UP' THEN low <= prev_close ELSE high >= prev_close END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS f FROM gp)
   WINDOW b AS (PARTITION BY symbol, gap_size ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), {V.FLOWS}, {V.mom_sql('gb')}, spx AS (SELECT date, CASE WHEN close >= open THEN 'UP' ELSE 'DOWN' END AS sp_dir FROM gb WHERE symbol = '2-HIGH'),
  vxx AS (SELECT date, (close - 1000) * 4 AS vix FROM gb WHERE symbol = '5-LOW'),
  gi AS (SELECT gp.symbol, gp.date, direction, gp.gap_size, prev_close, CASE WHEN score > 0.5 THEN 'LONG' WHEN score < -0.5 THEN 'SHORT' ELSE 'NEUTRAL' END AS mt, coalesce(sp_dir, 'UNKNOWN') AS sp, vix, net, fill_rate AS fr FROM gpf gp JOIN mom ON gp.symbol = mom.symbol AND gp.date = mom.date
   LEFT JOIN spx ON gp.date = spx.date LEFT JOIN vxx ON gp.date = vxx.date LEFT JOIN flows ON gp.date = flows.date),
  gq AS (SELECT *, CASE WHEN direction = 'UP' THEN 'LONG' ELSE 'SHORT' END AS wy, CASE WHEN vix IS NULL THEN 'UNKNOWN' WHEN vix > 25 THEN 'HIGH' WHEN vix > 20 THEN 'ELEVATED' ELSE 'NORMAL' END AS vr, CASE WHEN net > 0 THEN 'UP' WHEN net < 0 THEN 'DOWN' ELSE 'NONE' END AS fl FROM gi),
  gs AS (SELECT *, CAST(mt IN ('LONG', 'SHORT') AND mt = wy AS INTEGER) + CAST(sp <> 'UNKNOWN' AND sp = direction AS INTEGER) + CAST(vr = 'NORMAL' AS INTEGER) + CAST(fl = direction AS INTEGER) + CAST(coalesce(fr <= 0.65, false) AS INTEGER) AS breakout,
   CAST(mt IN ('LONG', 'SHORT') AND mt <> wy AS INTEGER) + CAST(sp <> 'UNKNOWN' AND sp <> direction AS INTEGER) + CAST(vr = 'HIGH' AS INTEGER) + CAST(fl <> 'NONE' AND fl <> direction AS INTEGER) + CAST(coalesce(fr > 0.65, false) AS INTEGER) AS trap FROM gq),
  gc AS (SELECT *, CASE WHEN breakout > trap + 1 THEN 'BREAKOUT' WHEN trap > breakout + 1 THEN 'TRAP' WHEN breakout = trap AND fr > 0.55 AND gap_size IN ('LARGE', 'EXTREME') THEN 'TRAP' ELSE 'UNCERTAIN' END AS gap_class FROM gs)"""


def _gap_score(spark, sf):
    from barloom.operators.signals import momentum_score

    b = V.bars(spark, sf).withColumns({c: 1000 + F.col(c) / 50000 for c in ("open", "high", "low", "close")})
    g = M.fill_rate_before(M.gap_detect(b))
    mom = momentum_score(b.select("symbol", "date", "close")).select(
        "symbol", "date", ladder("score", [(">", 0.5, "LONG"), ("<", -0.5, "SHORT")], "NEUTRAL").alias("mtf_trend"))
    sp = b.filter("symbol = '2-HIGH'").select("date", F.when(F.col("close") >= F.col("open"), "UP").otherwise("DOWN").alias("sp_dir"))
    vix = b.filter("symbol = '5-LOW'").select("date", ((F.col("close") - 1000) * 4).alias("vix"))
    fl = V.flows(spark, sf).select("date", F.col("net").alias("flow_net"))
    j = g.join(mom, ["symbol", "date"]).join(sp, "date", "left").join(vix, "date", "left").join(fl, "date", "left")
    j = j.withColumn("sp_dir", F.coalesce("sp_dir", F.lit("UNKNOWN")))
    return M.gap_score(j)


@query("gp_3_gap_score", f"""WITH {GSC} SELECT symbol, date, breakout, trap, gap_class, CASE WHEN gap_class = 'BREAKOUT' THEN CASE WHEN direction = 'UP' THEN 'BUY_DIPS' ELSE 'SHORT_BOUNCES' END
  WHEN gap_class = 'TRAP' THEN CASE WHEN direction = 'UP' THEN 'WAIT_FOR_FILL_BEFORE_LONG' ELSE 'WAIT_FOR_FILL_BEFORE_SHORT' END ELSE 'WAIT_FOR_CONFIRMATION' END AS recommendation, round(prev_close, 6) AS wait_level FROM gc""")
def gap_score(spark, sf):
    return _gap_score(spark, sf).select("symbol", "date", "breakout", "trap", "gap_class", M.gap_recommendation().alias("recommendation"), rnd("wait_level").alias("wait_level"))


# ------------------------------------------------------------------------- calendar

CAL_RULES = [("E1", "EVENT ONE", "HIGH"), ("E2", "EVENT TWO", "MEDIUM"), ("E33", "EVENT THIRTYTHREE", "HIGH")]


def _match_sql(col: int) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(event), '{k.lower()}') THEN '{(n, i)[col]}'" for k, n, i in CAL_RULES) + " END"


@query("ec_1_calendar_match", f"""WITH {V.CALENDAR}, m AS (SELECT *, {_match_sql(0)} AS nm, {_match_sql(1)} AS lv FROM calendar WHERE impact IN ('HIGH', 'MEDIUM'))
  SELECT id, coalesce(nm, event) AS event_name, coalesce(lv, impact) AS impact FROM m WHERE nm IS NOT NULL OR (impact = 'HIGH' AND country IN ('7', '12'))""")
def calendar_match(spark, sf):
    return M.calendar_match(V.calendar(spark, sf), CAL_RULES, domestic=("7", "12")).select("id", "event_name", "impact")


@query("ec_1_calendar_window", f"""WITH {V.CALENDAR}, m AS (SELECT *, {_match_sql(0)} AS nm, {_match_sql(1)} AS lv FROM calendar WHERE impact IN ('HIGH', 'MEDIUM') AND date BETWEEN DATE '1999-06-13' AND DATE '1999-06-27')
  SELECT id, date, nm AS event_name, coalesce(lv, impact) AS impact FROM m WHERE nm IS NOT NULL""")
def calendar_window(spark, sf):
    d = M.calendar_match(V.calendar(spark, sf), CAL_RULES, domestic=(), as_of=F.lit("1999-06-13").cast("date"))
    return d.select("id", "date", "event_name", "impact")


@query("ec_2_calendar_merge", f"""WITH {V.CALENDAR}, d AS (SELECT * FROM calendar QUALIFY row_number() OVER (PARTITION BY lower(event), date ORDER BY CASE source WHEN 'FEED' THEN 0 ELSE 1 END, id) = 1),
  o AS (SELECT event, date, 'OLD' AS source, 'LOW' AS impact FROM d WHERE year(date) = 1996 UNION ALL SELECT 'E0', DATE '1980-01-01', 'OLD', 'LOW')
  SELECT event, date, source, impact FROM d UNION ALL SELECT event, date, source, impact FROM o WHERE date = DATE '1980-01-01'""")
def calendar_merge(spark, sf):
    prio = F.when(F.col("source") == "FEED", 0).otherwise(1)
    new = M.calendar_merge(V.calendar(spark, sf), [prio, F.col("id")]).select("event", "date", "source", "impact")
    old = new.filter(F.year("date") == 1996).withColumns({"source": F.lit("OLD"), "impact": F.lit("LOW")})
    kept = new.groupBy().agg(F.lit("E0").alias("event"), F.lit("1980-01-01").cast("date").alias("date"),
                             F.lit("OLD").alias("source"), F.lit("LOW").alias("impact"))
    return upsert(old.unionByName(kept), new, ["event", "date"])
