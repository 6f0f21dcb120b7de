"""Decision fusion, sizing and execution friction (DC, RK, FR)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import clip, ladder, map_label, weighted_sum
from barloom.operators.backtest import BASE_WEIGHTS

LAYERS = tuple(BASE_WEIGHTS)

# Macro layer per asset class and market regime.
REGIME_SCORES = {
    "equity": {"Bull Market": 0.4, "Bear Market": -0.5, "Crisis": -0.7},
    "gold": {"Bull Market": -0.2, "Bear Market": 0.3, "Crisis": 0.6},
    "crude": {"Bull Market": 0.3, "Bear Market": -0.3, "Crisis": 0.2},
}


def layer_scores(df: DataFrame) -> DataFrame:
    """Six layer columns from score, prob_positive, sentiment, asset_class, regime, spread, vix_pct."""
    macro = F.lit(0.0)
    for cls, table in REGIME_SCORES.items():
        macro = F.when(F.col("asset_class") == cls, map_label("regime", table, 0.0)).otherwise(macro)
    spread = F.col("spread")
    curve = F.when(spread < 0, -0.4).when(spread > 1.0, 0.3).otherwise(spread * 0.3)
    prob = F.coalesce("prob_positive", F.lit(50.0))
    return df.withColumns({
        "signal_layer": F.coalesce("score", F.lit(0.0)), "analog_layer": F.round((prob - 50.0) / 50.0, 3),
        "sentiment_layer": clip(F.coalesce("sentiment", F.lit(0.0)), -1, 1), "macro_layer": macro,
        "yield_layer": F.coalesce(F.round(curve, 3), F.lit(0.1)),
        "vix_layer": F.round(-(F.coalesce("vix_pct", F.lit(50.0)) - 50.0) / 100.0, 3),
    })


def fuse_layers(df: DataFrame, weights: Mapping[str, float] = BASE_WEIGHTS) -> DataFrame:
    """Halve an unstable signal, scale it by its hit rate, then add the weighted layers."""
    steady = F.when(F.col("stable") == F.col("signal"), 1.0).otherwise(0.5)
    hit = clip((F.coalesce("hit_rate", F.lit(0.5)) - 0.5) * 2 + 1, 0.5, 1.5)
    d = df.withColumn("signal_layer", F.col("signal_layer") * steady * hit)
    return d.withColumn("combined", weighted_sum({f"{k}_layer": w for k, w in weights.items()}))


def decide(df: DataFrame, cut: float = 0.20, min_agreement: float = 50.0) -> DataFrame:
    """Agreement of the layer signs, decision and confidence."""
    layers = F.array(*[F.col(f"{k}_layer") for k in LAYERS])
    c = F.col("combined")
    agree = F.when(c > 0, F.size(F.filter(layers, lambda x: x > 0))).when(
        c < 0, F.size(F.filter(layers, lambda x: x < 0))).otherwise(0)
    d = df.withColumn("agreement", agree * 100.0 / len(LAYERS))
    a = F.col("agreement")
    decision = F.when((c >= cut) & (a >= min_agreement), "LONG").when(
        (c <= -cut) & (a >= min_agreement), "SHORT").otherwise("NO TRADE")
    s = F.abs(c)
    conf = (F.when((s >= 0.40) & (a >= 70), "HIGH").when((s >= 0.25) & (a >= 60), "MEDIUM")
            .when((s >= 0.15) & (a >= 50), "LOW").otherwise("NONE"))
    return d.withColumns({"decision": decision, "confidence": conf})


def reasons() -> Column:
    """Array of reason strings of a decision row."""
    p, s = F.coalesce("prob_positive", F.lit(50.0)), F.coalesce("sentiment", F.lit(0.0))
    steady = F.when(F.col("stable") == F.col("signal"), "stable").otherwise("not yet stable")
    return F.array_compact(F.array(
        F.concat(F.lit("Signal "), F.col("signal"), F.lit(" ("), steady, F.lit(")")),
        F.when(p >= 60, "Analogs bullish").when(p <= 40, "Analogs bearish").otherwise("Analogs neutral"),
        F.when(s > 0.3, "Sentiment positive").when(s < -0.3, "Sentiment negative"),
        F.concat(F.lit("Regime: "), F.coalesce("regime", F.lit("Unknown"))),
        F.when(F.col("spread") < 0, "Yield curve inverted").when(F.col("spread").isNotNull(), "Yield curve normal"),
        F.when(F.col("vix_pct") > 75, "VIX elevated").when(F.col("vix_pct") < 30, "VIX calm"),
    ))


def overlay_adjustments(decisions: DataFrame, overlays: Sequence[DataFrame], keys: Sequence[str] = ("symbol", "date"),
                        apply: bool = False) -> DataFrame:
    """Sum of the overlay columns of other modules; added to the score only if `apply`."""
    d = decisions.withColumn("overlay", F.lit(0.0))
    for o in overlays:
        d = d.join(o.select(*keys, F.col("adjustment").alias("_a")), list(keys), "left")
        d = d.withColumn("overlay", F.col("overlay") + F.coalesce("_a", F.lit(0.0))).drop("_a")
    total = F.col("combined") + F.col("overlay") if apply else F.col("combined")
    return d.withColumn("final_score", clip(total, -1, 1))


# ------------------------------------------------------------------------- sizing


def kelly_size(df: DataFrame, cap: float = 20.0, floor: float = 2.0) -> DataFrame:
    """Half Kelly from hit_rate, win_pct, atr_pct and annual_vol, capped and floored (percent)."""
    win = F.greatest(F.abs("win_pct"), F.lit(0.5))
    loss = F.greatest(F.col("atr_pct") * 3.0, F.lit(0.5))
    p, b = F.col("hit_rate"), win / loss
    raw = F.when((p <= 0) | (b <= 0), 0.0).otherwise(clip((p * b - (1 - p)) / b, 0, 1))
    d = df.withColumn("_k", raw)
    pct = F.col("_k") / 2.0 * 100.0
    size = F.when(pct > 0, F.least(F.greatest(pct, F.lit(floor)), F.lit(cap))).otherwise(F.lit(0.0))
    d = d.withColumns({"kelly_raw": F.round(F.col("_k") * 100.0, 2), "position_pct": F.round(size, 2), "_s": size})
    return d.withColumn("max_dd_est", F.round(F.col("_s") * F.col("annual_vol") * 1.5, 2)).drop("_k", "_s")


def _both_ways(corr: DataFrame) -> DataFrame:
    back = corr.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")
    return corr.select("a", "b", "corr").unionByName(back)


def corr_haircut(sizing: DataFrame, corr: DataFrame, high: float = 0.70, low: float = 0.30,
                 reduction: float = 0.30) -> DataFrame:
    """Cut a position once per highly correlated partner in the same direction.

    `sizing(symbol, bias, position_pct)`, `corr(a, b, corr)` of the tracked pairs.
    """
    act = sizing.filter(F.col("bias").isin("LONG", "SHORT") & (F.col("position_pct") > 0)).select("symbol", "bias")
    pairs = (
        _both_ways(corr)
        .join(act.select(F.col("symbol").alias("a"), "bias"), "a")
        .join(act.select(F.col("symbol").alias("b"), F.col("bias").alias("_b")), "b")
        .filter(F.col("bias") == F.col("_b"))
    )
    c = F.col("corr")
    per = pairs.groupBy(F.col("a").alias("symbol")).agg(
        F.count_if(c > high).alias("n_high"), F.count_if(c < low).alias("n_low"), F.max("corr").alias("max_corr"))
    d = sizing.join(per, "symbol", "left").na.fill(0, ["n_high", "n_low"])
    flag = F.when(F.col("n_high") > 0, "HIGH_CORR_WARNING").when(F.col("n_low") > 0, "DIVERSIFIED").otherwise("OK")
    return d.withColumns({
        "corr_flag": flag,
        "adj_position": F.round(F.col("position_pct") * F.pow(F.lit(1.0 - reduction), F.col("n_high")), 2)})


def portfolio_vol_dd(sizing: DataFrame, corr: DataFrame, missing: float = 0.3) -> DataFrame:
    """Portfolio volatility over all pairs of active positions, drawdown estimate and level (one row).

    A pair without a correlation counts with `missing`; without an active position the level is NONE. Positions are one
    row per tracked symbol. The sum over all pairs is the square of the summed risks with correlation `missing`, put
    right for the pairs that have one, so no pair rows are made.
    """
    act = sizing.filter(F.col("bias").isin("LONG", "SHORT") & (F.col("adj_position") > 0))
    risk = act.select("symbol", (F.col("adj_position") / 100.0 * F.col("annual_vol")).alias("_r"))
    r = F.col("_r")
    own = risk.select((r * r * (1 - missing)).alias("_v"), r.alias("_s"), F.lit(1).alias("_n"))
    cross = (
        _both_ways(corr).filter(F.col("a") != F.col("b"))
        .join(risk.select(F.col("symbol").alias("a"), F.col("_r").alias("_x")), "a")
        .join(risk.select(F.col("symbol").alias("b"), F.col("_r").alias("_y")), "b")
        .select((F.col("_x") * F.col("_y") * F.coalesce(F.col("corr") - missing, F.lit(0.0))).alias("_v"), F.lit(0.0).alias("_s"), F.lit(0).alias("_n"))
    )
    total = F.coalesce(F.sum("_v"), F.lit(0.0)) + missing * F.pow(F.coalesce(F.sum("_s"), F.lit(0.0)), F.lit(2))
    one = own.unionByName(cross).agg(F.sqrt(F.greatest(total, F.lit(0.0))).alias("port_vol"), F.sum("_n").alias("_n"))
    dd = F.round(F.col("port_vol") * 1.65 * 100.0, 2)
    level = ladder("max_dd_pct", [(">=", 25.0, "CRITICAL"), (">=", 15.0, "WARNING")], "OK")
    return one.withColumn("max_dd_pct", dd).withColumn("level", F.when(F.col("_n") > 0, level).otherwise("NONE")).drop("_n")


def action_text(level: str | Column = "level") -> Column:
    lv = F.col(level) if isinstance(level, str) else level
    size = F.format_string("%.1f%%", F.col("adj_position"))
    tail = (
        F.when(F.col("corr_flag") == "HIGH_CORR_WARNING",
               F.concat(F.lit(" (reduced from "), F.format_string("%.1f%%", F.col("position_pct")), F.lit(")")))
        .when(F.col("corr_flag") == "DIVERSIFIED", F.lit(" (full size, diversified)")).otherwise(F.lit(""))
    )
    return (
        F.when((F.col("bias") == "NO TRADE") | (F.col("adj_position") == 0), F.lit("WAIT"))
        .when(lv == "CRITICAL", F.concat(F.col("bias"), F.lit(" "), size, F.lit(" CUT TO "),
                                         F.format_string("%.1f%%", F.col("adj_position") * 0.5)))
        .otherwise(F.concat(F.col("bias"), F.lit(" "), size, F.lit(" of portfolio"), tail))
    )


# ------------------------------------------------------------------------- friction

# Base and high slippage per asset, spreads.
SLIPPAGE = {"NIFTY": (0.0005, 0.0010), "SP500": (0.0003, 0.0008), "Gold": (0.0004, 0.0009),
            "Silver": (0.0008, 0.0015), "Crude": (0.0005, 0.0012)}
SPREAD_NORMAL, SPREAD_ELEVATED, SPREAD_CRISIS, SPREAD_EVENT = 0.0010, 0.0015, 0.0025, 0.0020


def friction(df: DataFrame) -> DataFrame:
    """Slippage, spread and their sum from asset, vix, event_today, event_tomorrow."""
    base = map_label("asset", {a: v[0] for a, v in SLIPPAGE.items()})
    high = map_label("asset", {a: v[1] for a, v in SLIPPAGE.items()})
    vix, event = F.col("vix"), F.col("event_today") | F.col("event_tomorrow")
    slip = F.when(vix > 25, high).otherwise(base) + F.when(event, base * 0.5).otherwise(0.0)
    spread = F.when(vix > 30, SPREAD_CRISIS).when(vix > 20, SPREAD_ELEVATED).otherwise(SPREAD_NORMAL)
    spread = F.when(vix.isNotNull() & event, F.greatest(spread, F.lit(SPREAD_EVENT))).otherwise(spread)
    d = df.withColumns({"slippage": slip, "spread_cost": spread})
    return d.withColumn("friction", F.col("slippage") + F.col("spread_cost"))


def timing_quality(friction_col: str = "friction") -> Column:
    event = F.col("event_today") | F.col("event_tomorrow")
    f = F.col(friction_col)
    return (
        F.when((F.col("vix") > 30) & event, "AVOID").when(f <= 0.0010, "GOOD_TIME")
        .when(f <= 0.0020, "AVERAGE_TIME").otherwise("POOR_TIME")
    )


def event_proximity(days: DataFrame, events: DataFrame, date: str = "date") -> DataFrame:
    """Flags: high-impact event today, tomorrow, within 48 hours, within 7 days.

    Each event date is spread over the eight days it affects, so the lookup is an equi join.
    """
    dates = events.select(F.col(date).alias("_e")).distinct()
    spread = dates.select(F.explode(F.sequence(F.date_sub("_e", 7), F.col("_e"))).alias(date), "_e")
    near = spread.groupBy(date).agg(F.min(F.datediff("_e", date)).alias("_d"),
                                    F.max(F.datediff("_e", date) == 1).alias("_t"))
    d = days.join(near, date, "left")
    gap, no = F.col("_d"), F.lit(False)
    return d.withColumns({
        "event_today": F.coalesce(gap == 0, no), "event_tomorrow": F.coalesce(F.col("_t"), no),
        "event_48h": F.coalesce(gap <= 2, no), "event_7d": F.coalesce(gap <= 7, no)}).drop("_d", "_t")
