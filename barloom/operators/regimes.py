"""Market, macro, correlation and liquidity regimes (RG).

Panels and macro series hold one row per date, so windows without a partition key see at most one
row per calendar day.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import (
    cumulative, diff, lag, normalise_pm1, ordered, pct_change, pct_le_full, range_position, rank_pct_full,
    rank_pct_rolling, realised_vol, rolling, rolling_corr, rolling_std, sma, whole, zscore,
)
from barloom.functions.scalar import clip, col, ladder, linear_score, map_label, weighted_sum

NOKEY = {"by": ()}


def surprise_index(series: DataFrame, value: str = "value", n: int = 12, by="series_id",
                   date: str = "date", out: str = "surprise") -> DataFrame:
    """Deviation from the n-row mean, standardised over n rows and clipped to ±3."""
    k = {"by": by, "order": date}
    s = series.withColumn("_sp", F.col(value) - sma(value, n, **k))
    return s.withColumn(out, zscore("_sp", n, limit=3, **k)).drop("_sp")


# ------------------------------------------------------------------------- volatility and flows


def vix_trend_regime(df: DataFrame, vix: str, price: str, n: int = 200) -> DataFrame:
    d = df.withColumn("_ma", sma(price, n, **NOKEY)).filter(F.col("_ma").isNotNull())
    above, v = F.col(price) > F.col("_ma"), F.col(vix)
    label = (
        F.when(v > 30, "Crisis").when((v > 20) & ~above, "Bear Market")
        .when((v <= 20) & above, "Bull Market").otherwise("Sideways")
    )
    return d.withColumn("regime", label).drop("_ma")


VOL_REGIME_STEPS = [("<", 15.0, 1), ("<", 20.0, 2), ("<", 30.0, 3)]


def vol_regime(vix: str | Column) -> Column:
    """1 complacency, 2 normal, 3 elevated, 4 crisis."""
    return ladder(vix, VOL_REGIME_STEPS, 4)


def vol_risk_premium(df: DataFrame, vix: str, ret: str) -> DataFrame:
    return df.withColumns({
        "vrp": F.col(vix) - realised_vol(ret, 20, **NOKEY),
        "vix_pct_rank": rank_pct_rolling(vix, 252, **NOKEY) * 100.0,
    })


def risk_appetite(df: DataFrame, vix: str, nifty: str, sp: str, dxy: str, vix_local: str, fx: str) -> DataFrame:
    """Mean of four range positions, and the 0.4/0.3/0.3 flow proxy."""
    for name in (nifty, sp):
        df = df.withColumn(f"_m_{name}", sma(name, 20, **NOKEY) / sma(name, 60, **NOKEY) * 100.0)
    pos = {c: range_position(c, 252, **NOKEY) for c in (vix, dxy, vix_local, fx, f"_m_{nifty}", f"_m_{sp}")}
    d = df.withColumns({f"_p_{c}": e for c, e in pos.items()})
    p = {c: F.col(f"_p_{c}") for c in pos}
    mom, mom_sp = p[f"_m_{nifty}"], p[f"_m_{sp}"]
    return d.withColumns({
        "risk_appetite": (100 - p[vix] + mom + mom_sp + 100 - p[dxy]) / 4,
        "flow_proxy": (100 - p[vix_local]) * 0.4 + (100 - p[fx]) * 0.3 + mom * 0.3,
    }).drop(f"_m_{nifty}", f"_m_{sp}", *[f"_p_{c}" for c in pos])


def geo_risk(df: DataFrame, vix: str, r_sp: str, r_gold: str, r_fx: str, n: int = 252) -> DataFrame:
    """Weighted clipped z-score and momenta, 10-row mean; black swan above mean + 2 std over n rows."""
    def mom(r: str, k: float) -> Column:
        return clip(sma(r, 20, **NOKEY) * 252 * k, -3, 3)

    d = df.withColumns({
        "_a": zscore(vix, n, limit=3, **NOKEY), "_b": mom(r_sp, -2), "_c": mom(r_gold, 2), "_d": mom(r_fx, 3)})
    d = d.withColumn("_g", weighted_sum({"_a": 0.35, "_b": 0.30, "_c": 0.20, "_d": 0.15}))
    d = d.withColumn("geo_risk", sma("_g", 10, **NOKEY))
    limit = sma("geo_risk", n, **NOKEY) + 2 * rolling_std("geo_risk", n, **NOKEY)
    return d.withColumn("black_swan", F.col("geo_risk") > limit).drop("_a", "_b", "_c", "_d", "_g")


def sentiment_proxy(df: DataFrame, vix: str, n: int = 252) -> DataFrame:
    d = df.withColumn("_z", -zscore(vix, n, limit=3, **NOKEY))
    d = d.withColumn("_p", range_position("_z", n, **NOKEY) / 100.0)
    return d.withColumn("sentiment_proxy", sma("_p", 20, **NOKEY)).drop("_z", "_p")


# ------------------------------------------------------------------------- macro


def macro_quadrant(cpi: str | Column, growth: str | Column) -> Column:
    c, g = col(cpi), col(growth)
    high, good = c > 3.0, g > 0
    return (
        F.when(c.isNull() | g.isNull(), F.lit(None)).when(~high & good, "Goldilocks").when(high & good, "Overheating")
        .when(high, "Stagflation").otherwise("Recession/Slowdown")
    )


def regime_performance(returns: DataFrame, regimes: DataFrame, symbols: Sequence[str], on: str = "month") -> DataFrame:
    """Mean monthly return by regime and symbol."""
    return returns.join(regimes, on).groupBy("regime").pivot("symbol", list(symbols)).agg(F.avg("ret"))


def esi_composite(df: DataFrame, payrolls: str, gdp: str, unemployment: str, cpi: str) -> DataFrame:
    """Weighted surprise composite and its 3-row mean; unemployment counts inverted."""
    for c in (payrolls, gdp, unemployment, cpi):
        df = surprise_index(df, c, by=(), out=f"_s_{c}")
    ok = df.na.drop(subset=[f"_s_{c}" for c in (payrolls, gdp, unemployment, cpi)])
    esi = (F.col(f"_s_{payrolls}") * 0.35 + F.col(f"_s_{gdp}") * 0.30 - F.col(f"_s_{unemployment}") * 0.20
           + F.col(f"_s_{cpi}") * 0.15)
    d = ok.withColumn("esi", esi)
    return d.withColumn("esi_smooth", sma("esi", 3, **NOKEY)).select("date", "esi", "esi_smooth")


# Traffic lights of the scorecard.
SCORECARD = {
    "cpi_yoy": ([("<", 2.5, "Low"), ("<", 4.0, "Elevated")], "High"),
    "gdp": ([(">", 2.0, "Strong"), (">", 0.0, "Moderate")], "Contraction"),
    "unemployment": ([("<", 4.0, "Low"), ("<", 5.5, "Normal")], "High"),
    "policy_rate": ([("<", 2.0, "Low"), ("<", 4.0, "Neutral")], "Restrictive"),
    "real_rate": ([(">", 0.0, "Positive")], "Negative"),
    "curve": ([(">", 0.5, "Normal"), (">", 0.0, "Flat")], "Inverted"),
    "esi": ([(">", 0.3, "Beating"), (">", -0.3, "In-line")], "Missing"),
    "payrolls": ([(">", 200.0, "Strong"), (">", 100.0, "Moderate")], "Weak"),
}


def scorecard(df: DataFrame, indicators: Sequence[str] = tuple(SCORECARD), date: str = "date") -> DataFrame:
    """(indicator, value, signal): latest non-missing value of each indicator with its light."""
    one = df.agg(*[
        F.max_by(F.col(i), F.when(F.col(i).isNotNull(), F.col(date))).alias(i) for i in indicators])
    cells = [
        F.struct(F.lit(i).alias("indicator"), F.col(i).alias("value"), ladder(i, *SCORECARD[i]).alias("signal"))
        for i in indicators
    ]
    return one.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


# Fixed values.
US = {"trend": 2.0, "cpi": 3.0}
REGIONAL_STEPS = {"growth": (6.0, 5.0), "cpi": (6.0, 5.0)}


def macro_regime_us(cpi: str | Column, gdp: str | Column, prev_gdp: str | Column) -> Column:
    """Five labels; a jump from below to above trend by more than a point is a recovery."""
    c, g, p = col(cpi), col(gdp), col(prev_gdp)
    t, hot = US["trend"], US["cpi"]
    return (
        F.when(c.isNull() | g.isNull(), "UNKNOWN")
        .when((p < t) & (g >= t) & (g > p + 1.0), "RECOVERY")
        .when((g > t) & (c < hot), "GOLDILOCKS").when((g > t) & (c >= hot), "OVERHEATING")
        .when((g < t) & (c >= hot), "STAGFLATION").when((g < t) & (c < hot), "RECESSION").otherwise("UNKNOWN")
    )


def macro_regime_regional(cpi: str | Column, growth: str | Column) -> Column:
    c, g = col(cpi), col(growth)
    (strong, weak), (high, ok) = REGIONAL_STEPS["growth"], REGIONAL_STEPS["cpi"]
    return (
        F.when(c.isNull() | g.isNull(), "UNKNOWN")
        .when((g >= strong) & (c < ok), "INDIA_GOLDILOCKS").when(g >= strong, "INDIA_OVERHEATING")
        .when((g < weak) & (c >= high), "INDIA_STAGFLATION").when((g < weak) & (c < ok), "INDIA_SLOWDOWN")
        .when(c >= high, "INDIA_OVERHEATING").otherwise("INDIA_SLOWDOWN")
    )


# Regional to generic labels, adjustments per regime.
TO_GENERIC = {
    "INDIA_GOLDILOCKS": "GOLDILOCKS", "INDIA_OVERHEATING": "OVERHEATING", "INDIA_STAGFLATION": "STAGFLATION",
    "INDIA_SLOWDOWN": "RECESSION", "INDIA_RECOVERY": "RECOVERY",
}
US_ADJUST = {  # SP500, Gold, Silver, Crude
    "GOLDILOCKS": (0.10, -0.10, -0.05, 0.0), "OVERHEATING": (-0.05, 0.10, 0.05, 0.10),
    "STAGFLATION": (-0.15, 0.15, 0.05, 0.0), "RECESSION": (-0.15, 0.10, 0.0, -0.15),
    "RECOVERY": (0.10, 0.0, 0.05, 0.05),
}
REGIONAL_ADJUST = {"INDIA_GOLDILOCKS": 0.10, "INDIA_OVERHEATING": 0.0, "INDIA_STAGFLATION": -0.15,
                   "INDIA_SLOWDOWN": -0.05, "INDIA_RECOVERY": 0.10}


def transition(df: DataFrame, regime: str = "us_regime", gdp: str = "gdp", prev_gdp: str = "prev_gdp",
               by: Sequence[str] = ()) -> DataFrame:
    """Flag from the two preceding regimes, the current one and the direction of growth."""
    r = F.col(regime)
    a, b = lag(regime, 1, by=by), lag(regime, 2, by=by)
    d = df.withColumns({"_a": a, "_b": b})

    def both(*labels: str) -> Column:
        return F.col("_a").isin(*labels) & F.col("_b").isin(*labels)

    up, down = F.col(gdp) > F.col(prev_gdp), F.col(gdp) < F.col(prev_gdp)
    flag = (
        F.when(both("STAGFLATION", "RECESSION") & r.isin("GOLDILOCKS", "RECOVERY", "OVERHEATING"), "REGIME_IMPROVING")
        .when(both("STAGFLATION", "RECESSION") & up, "POTENTIAL_RECOVERY")
        .when(both("GOLDILOCKS") & r.isin("OVERHEATING", "STAGFLATION", "RECESSION"), "REGIME_DETERIORATING")
        .when(both("OVERHEATING") & down & r.isin("STAGFLATION", "RECESSION"), "STAGFLATION_RISK")
        .when(both("OVERHEATING") & (r == "GOLDILOCKS"), "DISINFLATION")
    )
    return d.withColumn("transition", flag).drop("_a", "_b")


def divergence(us: str | Column, other_generic: str | Column) -> Column:
    a, b = col(us), col(other_generic)
    return F.when(a == b, F.concat(F.lit("ALIGNED_"), a)).otherwise(F.concat(a, F.lit("_VS_"), b))


def regime_adjustments(df: DataFrame, us: str = "us_regime", regional: str = "regional", flag: str = "transition",
                       spill: float = 0.30) -> DataFrame:
    """Adjustment per asset; the regional asset takes its own plus a share of the US equity one."""
    half = F.when(F.coalesce(F.col(flag).contains("POTENTIAL"), F.lit(False)), 0.5).otherwise(1.0)
    names = ("adj_sp500", "adj_gold", "adj_silver", "adj_crude")
    base = {n: map_label(us, {k: v[i] for k, v in US_ADJUST.items()}, 0.0) for i, n in enumerate(names)}
    own = map_label(regional, REGIONAL_ADJUST, 0.0) + base["adj_sp500"] * spill
    cols = {n: F.round(e * half, 4) for n, e in {**base, "adj_nifty": own}.items()}
    return df.withColumns(cols)


def fx_trend(df: DataFrame, price: str = "close", by: Sequence[str] = ("symbol",)) -> DataFrame:
    """20/60 momentum (offset n-1 rows), volatility and trend label of an exchange rate."""
    d = df.withColumn("_r", pct_change(price, by=by))
    m20 = (col(price) / lag(price, 19, by=by) - 1) * 100
    m60 = (col(price) / lag(price, 59, by=by) - 1) * 100
    d = d.withColumns({"mom20": m20, "mom60": m60, "vol20": realised_vol("_r", 20, by=by)})
    return d.withColumn("trend", ladder("mom20", [(">", 0.5, "WEAKENING"), ("<", -0.5, "STRENGTHENING")], "STABLE")).drop("_r")


# ------------------------------------------------------------------------- correlation and beta


def corr_shift(pairs: DataFrame, short: int = 20, long: int = 60, cut: float = 0.30,
               by: Sequence[str] = ("a", "b")) -> DataFrame:
    d = pairs.withColumns({f"corr{n}": rolling_corr("x", "y", n, by=by) for n in (short, long)})
    gap = F.col(f"corr{short}") - F.col(f"corr{long}")
    return d.withColumn("shift", F.when(F.abs(gap) >= cut, "SHIFT").when(gap.isNotNull(), "STABLE"))


def corr_regime(gold_sp: str | Column, nifty_sp: str | Column) -> Column:
    g, n = F.coalesce(col(gold_sp), F.lit(0.0)), F.coalesce(col(nifty_sp), F.lit(0.5))
    return (
        F.when(g > 0.20, "RISK_OFF").when(n < 0.40, "DECOUPLING").when((n > 0.70) & (g < 0), "RISK_ON")
        .otherwise("NORMAL")
    )


# Reliability ladders of the key pairs.
RELIABILITY = {
    "Gold_SP500": ([(">", 0.20, "DEGRADED"), (">", 0.0, "REDUCED")], "FULL"),
    "NIFTY_SP500": ([("<", 0.40, "INDEPENDENT"), (">", 0.70, "US_LINKED")], "PARTIAL"),
    "Gold_Silver": ([(">", 0.80, "FULL"), (">", 0.60, "PARTIAL")], "DIVERGED"),
    "Crude_NIFTY": ([("<", -0.40, "BEARISH_PRESSURE"), (">", 0.30, "GROWTH_ALIGNED")], "NEUTRAL"),
}


def reliability(pair: str | Column, corr: str | Column) -> Column:
    p = col(pair)
    out = F.lit("FULL")
    for name, (steps, default) in RELIABILITY.items():
        out = F.when(p == name, ladder(corr, steps, default)).otherwise(out)
    return F.when(col(corr).isNotNull(), out)


def corr_episodes(series: DataFrame, corr: str = "corr", by: Sequence[str] = ("a", "b"), date: str = "date",
                  band: float = 0.15, min_days: int = 10, skip: int = 30, top: int = 5) -> DataFrame:
    """Past runs in which the correlation stayed near its latest value.

    A run ends on the first row outside the band; one that is still open at the end is dropped.
    """
    s = series.filter(F.col(corr).isNotNull())
    w = whole(by)
    d = s.withColumns({
        "_cur": F.max_by(corr, date).over(w),
        "_back": F.row_number().over(Window.partitionBy(*by).orderBy(F.col(date).desc())),
    }).filter(F.col("_back") > skip)
    d = d.withColumn("_in", F.abs(F.col(corr) - F.col("_cur")) <= band)
    start = F.col("_in") & ~F.coalesce(lag("_in", by=by, order=date), F.lit(False))
    d = d.withColumn("_start", start.cast("int")).withColumn("_run", F.sum("_start").over(cumulative(by, date)))
    g = d.filter("_run > 0").groupBy(*by, "_run").agg(
        F.min(date).alias("start_date"), F.min(F.when(~F.col("_in"), F.col(date))).alias("end_date"),
        F.avg(F.when(F.col("_in"), F.col(corr))).alias("avg_corr"))
    g = g.withColumn("duration", F.datediff("end_date", "start_date")).filter(F.col("duration") >= min_days)
    rank = Window.partitionBy(*by).orderBy(F.year("start_date").desc(), F.col("duration").desc(), F.col("start_date"))
    return g.withColumn("_k", F.row_number().over(rank)).filter(F.col("_k") <= top).drop("_k", "_run")


# Fixed values.
BETA_STEPS = [("<", -2.0, "HIGH_SENSITIVITY"), ("<", -0.5, "MEDIUM_SENSITIVITY"), (">", 2.0, "POSITIVE_CORRELATION")]
# Adjustment per sensitivity and yield direction.
BETA_ADJUST = {
    "HIGH_SENSITIVITY/RISING": -0.15, "HIGH_SENSITIVITY/FALLING": 0.10, "MEDIUM_SENSITIVITY/RISING": -0.05,
    "MEDIUM_SENSITIVITY/FALLING": 0.05, "POSITIVE_CORRELATION/RISING": 0.05, "POSITIVE_CORRELATION/FALLING": -0.05,
}


def beta_regime(beta: str | Column) -> Column:
    return ladder(beta, BETA_STEPS, "LOW_SENSITIVITY")


def yield_direction(df: DataFrame, y: str, by: Sequence[str] = (), date: str = "date") -> DataFrame:
    """10-row change of at least 10 bp decides, else the 30-row change; UNKNOWN before 31 rows."""
    d10, d30 = (diff(y, k, by=by, order=date) for k in (10, 30))
    d = df.withColumns({"chg10": d10, "chg30": d30})
    slow = F.when(F.col("chg30") > 0.05, "RISING").when(F.col("chg30") < -0.05, "FALLING").otherwise("FLAT")
    return d.withColumn("yield_direction", F.when(F.col("chg30").isNull(), "UNKNOWN").when(F.col("chg10") >= 0.10, "RISING")
                        .when(F.col("chg10") <= -0.10, "FALLING").otherwise(slow))


def beta_adjustment(regime: str = "beta_regime", direction: str = "yield_direction") -> Column:
    return map_label(F.concat_ws("/", F.col(regime), F.col(direction)), BETA_ADJUST, 0.0)


def beta_context(df: DataFrame, beta: str = "beta", by: Sequence[str] = ("a", "b"), date: str = "date",
                 skip: int = 30) -> DataFrame:
    """Latest beta, its share of history, days in the same band and the last such day outside the
    newest `skip` band days."""
    s = df.filter(F.col(beta).isNotNull()).withColumn("_reg", beta_regime(beta))
    w = whole(by)
    s = s.withColumns({"_cur": F.max_by(beta, date).over(w), "_creg": F.max_by("_reg", date).over(w)})
    s = s.withColumn("_same", F.col("_reg") == F.col("_creg"))
    back = Window.partitionBy(*by, "_same").orderBy(F.col(date).desc())
    s = s.withColumns({"_k": F.row_number().over(back), "_n": F.count(F.lit(1)).over(whole((*by, "_same")))})
    old = F.col("_same") & ((F.col("_k") > skip) | (F.col("_n") <= skip))
    return s.groupBy(*by).agg(
        F.max("_cur").alias("beta"), F.max("_creg").alias("beta_regime"),
        (F.avg(F.when(F.col(beta) <= F.col("_cur"), 1.0).otherwise(0.0)) * 100.0).alias("pct_rank"),
        F.count_if("_same").alias("total_days"), F.max(F.when(old, F.col(date))).alias("recent_date"))


def beta_scenarios(df: DataFrame, beta: str = "beta", moves: Sequence[int] = (10, 25, 50)) -> DataFrame:
    cells = F.array(*[F.lit(m) for m in moves])
    s = df.withColumn("move_bp", F.explode(cells))
    return s.withColumn("impact_pct", F.col(beta) * F.col("move_bp") / 100.0)


def equal_weight_index(bars: DataFrame, members: int, value: str = "close", key: str = "symbol",
                       date: str = "date") -> DataFrame:
    """Members rebased to 100 on the first common date and averaged per date."""
    n = bars.groupBy(date).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == members)
    common = bars.join(n.select(date), date, "left_semi")
    first = F.first(value).over(cumulative(key, date))
    return common.withColumn("_i", 100.0 * F.col(value) / first).groupBy(date).agg(F.avg("_i").alias("index"))


# Fixed values.
BREADTH_ADJUST = {"HEALTHY_BREADTH": 0.05, "EXTREME_POLARIZATION": -0.15, "MILD_POLARIZATION": 0.0}


def breadth_regime(corr: str = "corr", r2: str = "r2") -> tuple[Column, Column, Column]:
    """(regime, concentration, adjustment)."""
    c, r = F.col(corr), F.col(r2)
    regime = (F.when(c.isNull() | r.isNull(), F.lit(None)).when(c < 0.30, "EXTREME_POLARIZATION")
              .when((c >= 0.60) & (r < 0.50), "HEALTHY_BREADTH").otherwise("MILD_POLARIZATION"))
    conc = ladder(r, [(">=", 0.60, "NARROW"), ("<=", 0.40, "BROAD")], "MODERATE")
    return regime, conc, map_label(regime, BREADTH_ADJUST)


# ------------------------------------------------------------------------- premium and liquidity


def fair_value_inventory(df: DataFrame, price: str, inv_dev: str, n: int = 504, fallback: int = 90,
                         scale: float = 50_000.0, per: float = 5.0, by: Sequence[str] = ()) -> DataFrame:
    """Long mean (short one before it is full) minus the inventory signal, and the premium over it."""
    base = F.coalesce(sma(price, n, by=by), sma(price, fallback, by=by))
    d = df.withColumn("fair_value", base - F.coalesce(F.col(inv_dev), F.lit(0.0)) / scale * per)
    prem = F.try_divide(F.col(price) - F.col("fair_value"), F.col("fair_value")) * 100.0
    return d.withColumn("premium_pct", F.when(F.col("fair_value") > 0, prem).when(F.col("fair_value").isNotNull(), 0.0))


def fair_value_real_yield(df: DataFrame, price: str, real_yield: str, n: int = 126, sens: float = 0.05,
                          by: Sequence[str] = ()) -> DataFrame:
    d = df.withColumn("fair_value", sma(price, n, by=by) * (1 - F.col(real_yield) * sens))
    return d.withColumn("premium_pct", F.try_divide(F.col(price) - F.col("fair_value"), F.col("fair_value")) * 100.0)


# Fixed values.
PREMIUM_STEPS = [(">=", 30.0, "EXTREME_PREMIUM"), (">=", 15.0, "HIGH_PREMIUM"), (">=", 5.0, "MODERATE_PREMIUM"),
                 (">=", 0.0, "LOW_PREMIUM")]
PREMIUM_TREND = [(">=", 3.0, "EXPANDING"), ("<=", -3.0, "CONTRACTING")]


def premium_class(df: DataFrame, premium: str = "premium_pct", by: Sequence[str] = (), back: int = 10) -> DataFrame:
    """Class, 10-row trend and transition alert of a premium."""
    d = df.filter(F.col(premium).isNotNull())
    d = d.withColumns({"premium_class": ladder(premium, PREMIUM_STEPS, "DISCOUNT"),
                       "trend": ladder(diff(premium, back, by=by), PREMIUM_TREND, "STABLE", "UNKNOWN")})
    now, prev = F.col("premium_class"), lag("premium_class", by=by)
    alert = (
        F.when((now == "EXTREME_PREMIUM") & (prev != "EXTREME_PREMIUM"), "EXTREME")
        .when(prev.isin("LOW_PREMIUM", "DISCOUNT", "MODERATE_PREMIUM") & (now == "HIGH_PREMIUM"), "ESCALATING")
        .when(prev.isin("HIGH_PREMIUM", "EXTREME_PREMIUM") & (now == "MODERATE_PREMIUM"), "DEESCALATING")
        .otherwise("NONE")
    )
    return d.withColumn("alert", alert)


# Fixed values.
PULSE_WEIGHTS = {"tga_score": 0.30, "bs_score": 0.25, "tp_score": 0.20, "ys_score": 0.15, "hy_score": 0.10}
PULSE_STEPS = [(">=", 0.50, "HIGHLY_ACCOMMODATIVE"), (">=", 0.30, "ACCOMMODATIVE"), (">=", -0.10, "NEUTRAL"),
               (">=", -0.30, "TIGHTENING")]


def liquidity_pulse(df: DataFrame, tga: str = "tga", bs: str = "bs", tp: str = "tp", ys: str = "ys", hy: str = "hy") -> DataFrame:
    """Five sub-scores, weighted composite over those present, regime and overlay."""
    k = NOKEY
    d = df.withColumns({
        "tga_score": linear_score(diff(tga, 4, **k), -200_000.0), "bs_score": linear_score(diff(bs, 4, **k), 100_000.0),
        "tp_score": linear_score(tp, -1.0), "ys_score": linear_score(ys, 2.0), "hy_score": linear_score(hy, -4.0, 4.0)})
    num, den = F.lit(0.0), F.lit(0.0)
    for c, w in PULSE_WEIGHTS.items():
        num = num + F.coalesce(F.col(c), F.lit(0.0)) * w
        den = den + F.when(F.col(c).isNotNull(), w).otherwise(0.0)
    d = d.withColumn("composite", F.round(clip(F.coalesce(F.try_divide(num, den), F.lit(0.0)), -1, 1), 4))
    return d.withColumns({
        "regime": ladder("composite", PULSE_STEPS, "HIGHLY_RESTRICTIVE"),
        "overlay": ladder("composite", [(">=", 0.30, 0.05), ("<=", -0.30, -0.05)], 0.0)})


def fiscal_stance(df: DataFrame, value: str = "value", by: Sequence[str] = ("series_id",)) -> DataFrame:
    recent, prior = F.abs(sma(value, 3, by=by)), F.abs(sma(value, 3, skip=3, by=by))
    accel = F.when(prior == 0, 1.0).otherwise(recent / prior)
    d = df.withColumn("accel", accel)
    return d.withColumn("stance", ladder("accel", [(">=", 1.20, "STIMULATIVE"), ("<=", 0.80, "RESTRICTIVE")], "NEUTRAL", "UNAVAILABLE"))


# Composite liquidity.
LIQUIDITY_WEIGHTS = {"tga_score": 0.25, "bs_score": 0.20, "tp_score": 0.20, "hy_score": 0.15, "corr_score": 0.10, "yield_score": 0.10}
CORR_SCORE = {"RISK_ON": 0.5, "NORMAL": 0.0, "RISK_OFF": -1.0, "DECOUPLING": 0.0}
YIELD_SCORE = {"FALLING": 0.5, "STABLE": 0.0, "RISING": -0.5}
LIQUIDITY_STEPS = [(">=", 0.40, "ABUNDANT"), (">=", 0.10, "AMPLE"), (">=", -0.10, "NEUTRAL"), (">=", -0.40, "TIGHTENING")]
LIQUIDITY_ADJUST = {"ABUNDANT": 0.05, "AMPLE": 0.0, "NEUTRAL": 0.0, "TIGHTENING": -0.05, "SCARCE": -0.10}
ASSET_SENSITIVITY = {"SP500": 1.5, "NIFTY": 1.2, "Gold": 1.0, "Silver": 1.0, "Crude": 0.8}


def composite_liquidity(df: DataFrame, corr_label: str = "corr_regime", direction: str = "yield_direction") -> DataFrame:
    """Six weighted scores, band, base adjustment and 30-row mean; missing scores count as 0."""
    d = df.withColumns({"corr_score": map_label(corr_label, CORR_SCORE, 0.0), "yield_score": map_label(direction, YIELD_SCORE, 0.0)})
    total = F.lit(0.0)
    for c, w in LIQUIDITY_WEIGHTS.items():
        total = total + F.coalesce(F.col(c), F.lit(0.0)) * w
    d = d.withColumn("liquidity", clip(total, -1, 1))
    d = d.withColumn("band", ladder("liquidity", LIQUIDITY_STEPS, "SCARCE"))
    return d.withColumns({"adjustment": map_label("band", LIQUIDITY_ADJUST, 0.0),
                          "mean30": rolling(F.avg, "liquidity", 30, min_periods=1, by=())})


def asset_adjustments(df: DataFrame, base: str = "adjustment", mult: Mapping[str, float] = ASSET_SENSITIVITY) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(a).alias("asset"), F.lit(m).alias("_m")) for a, m in mult.items()])
    d = df.withColumn("_c", F.explode(cells))
    return d.withColumns({"asset": F.col("_c.asset"), "asset_adjustment": F.round(F.col(base) * F.col("_c._m"), 4)}).drop("_c")


# Fixed values.
RV_STEPS = [(">=", 90.0, "EXTREME_HIGH"), (">=", 80.0, "HIGH"), ("<=", 10.0, "EXTREME_LOW"), ("<=", 20.0, "LOW")]


def rv_ratio_signal(df: DataFrame, ratio: str = "ratio", n: int = 1260, by: Sequence[str] = ()) -> DataFrame:
    """Percentile of a price ratio in its last n rows and in full history, label and new extremes."""
    d = df.withColumns({"pct_roll": rank_pct_rolling(ratio, n, min_periods=30, by=by) * 100.0,
                        "pct_full": rank_pct_full(ratio, by=by) * 100.0})
    d = d.withColumn("rv_signal", ladder("pct_roll", RV_STEPS, "NEUTRAL", "UNKNOWN"))
    extreme = ("EXTREME_HIGH", "EXTREME_LOW")
    prev = lag("rv_signal", by=by)
    crossing = F.col("rv_signal").isin(*extreme) & F.coalesce(~prev.isin(*extreme), F.lit(True))
    return d.withColumn("new_extreme", crossing)
