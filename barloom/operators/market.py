"""Volatility term structure, futures basis, opening gaps and the event calendar (OP-4, BS, GP, EC)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import block_mean_change, lag, pct_le_full, pct_le_tail, rolling_std, sma
from barloom.functions.scalar import col, ladder, map_label
from barloom.operators.options import IV_STEPS
from barloom.operators.ranking import first_per_key


def vol_term_structure(df: DataFrame, vix: str, n: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the last n readings over the latest one, z-score and regime."""
    far, std = sma(vix, n, by=by), rolling_std(vix, n, by=by)
    d = df.withColumns({"_far": far, "_std": std})
    v = F.col(vix)
    d = d.withColumns({
        "ts_ratio": F.when(v > 0, F.col("_far") / v),
        "iv_zscore": F.when(F.col("_std") > 0, (v - F.col("_far")) / F.col("_std")).when(F.col("_std").isNotNull(), 0.0),
        "iv_regime": ladder(vix, IV_STEPS, "COMPRESSED")})
    return d.withColumn("ts_signal", ladder("ts_ratio", [(">=", 1.05, "CONTANGO"), ("<=", 0.95, "BACKWARDATION")], "FLAT",
                                            "UNAVAILABLE")).drop("_far", "_std")


# Score adjustment for longs per basis status (shorts get the opposite).
BASIS_ADJUST = {"BACKWARDATION": 0.15, "MILD_BACKWARDATION": 0.05, "NORMAL": 0.0, "CONTANGO": -0.05, "DEEP_CONTANGO": -0.15}


def futures_basis(df: DataFrame, front: str, second: str, normal: float, by: Sequence[str] = (),
                  history: int | None = 1260) -> DataFrame:
    """Front minus second contract: status, adjustments, share of history and 5/5 trend.

    The share is that of the last `history` rows up to the row; None ranks in the full sample, which is for the newest
    row only, as it looks ahead in all others.
    """
    d = df.withColumn("basis", F.col(front) - F.col(second))
    b, adj = F.col("basis"), F.col("basis") - normal
    status = (
        F.when(b.isNull(), "UNKNOWN").when(b > 0, "BACKWARDATION").when(adj > 0.5, "MILD_BACKWARDATION")
        .when(adj < -2.5, "DEEP_CONTANGO").when(adj < -0.5, "CONTANGO").otherwise("NORMAL")
    )
    d = d.withColumns({"status": status, "basis_pct": (pct_le_full("basis", by=by) if history is None else pct_le_tail("basis", history, by=by)) * 100.0,
                       "_c": block_mean_change("basis", 5, 5, by=by)})
    return d.withColumns({
        "adj_long": map_label("status", BASIS_ADJUST, 0.0), "adj_short": -map_label("status", BASIS_ADJUST, 0.0),
        "trend": ladder("_c", [(">", 0.5, "IMPROVING"), ("<", -0.5, "DETERIORATING")], "STABLE", "UNKNOWN")}).drop("_c")


# Fixed values.
GAP_STEPS = [("<", 0.3, "SMALL"), ("<", 0.8, "MEDIUM"), ("<", 1.5, "LARGE")]


def gap_detect(bars: DataFrame) -> DataFrame:
    """Opening gap against the previous close: points, percent, direction and size."""
    d = bars.withColumn("prev_close", lag("close")).filter(F.col("prev_close").isNotNull())
    d = d.withColumn("gap_points", F.col("open") - F.col("prev_close"))
    d = d.withColumn("gap_pct", F.col("gap_points") / F.col("prev_close") * 100.0)
    return d.withColumns({"direction": F.when(F.col("gap_pct") >= 0, "UP").otherwise("DOWN"),
                          "gap_size": ladder(F.abs("gap_pct"), GAP_STEPS, "EXTREME")})


def gap_fill_stats(gaps: DataFrame, by: Sequence[str] = ("gap_size",), min_n: int = 5, skip: float = 0.05) -> DataFrame:
    """Per size: number, fill rate and directed continuation of unfilled gaps."""
    up = F.col("direction") == "UP"
    filled = F.when(up, F.col("low") <= F.col("prev_close")).otherwise(F.col("high") >= F.col("prev_close"))
    cont = (F.col("close") - F.col("open")) / F.col("open") * 100.0
    d = gaps.filter(F.abs("gap_pct") > skip).withColumns({
        "_f": filled, "_c": F.when(up, cont).otherwise(-cont)})
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_f").cast("double")).alias("fill_rate"),
                           F.coalesce(F.avg(F.when(~F.col("_f"), F.col("_c"))), F.lit(0.0)).alias("avg_cont"))
    return g.filter(F.col("n") >= min_n)


def fill_rate_before(gaps: DataFrame, by: Sequence[str] = ("symbol", "gap_size"), min_n: int = 5, skip: float = 0.05, date: str = "date") -> DataFrame:
    """`gaps` with fill_rate: the share of the group's earlier gaps that were filled on their day, from `min_n` of them on."""
    up = F.col("direction") == "UP"
    filled = F.when(up, F.col("low") <= F.col("prev_close")).otherwise(F.col("high") >= F.col("prev_close")).cast("double")
    counted = F.when(F.abs("gap_pct") > skip, filled)
    before = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    return gaps.withColumn("fill_rate", F.when(F.count(counted).over(before) >= min_n, F.avg(counted).over(before)))


def gap_score(df: DataFrame) -> DataFrame:
    """Breakout and trap points from trend, lead market, volatility, flows and fill rate.

    Input: direction, gap_size, mtf_trend, sp_dir, vix, flow_net, fill_rate, prev_close.
    """
    up = F.col("direction") == "UP"
    way = F.when(up, "LONG").otherwise("SHORT")
    trend, sp, fr = F.col("mtf_trend"), F.col("sp_dir"), F.col("fill_rate")
    has = trend.isin("LONG", "SHORT")
    vix = ladder("vix", [(">", 25.0, "HIGH"), (">", 20.0, "ELEVATED")], "NORMAL", "UNKNOWN")
    flow = F.when(F.col("flow_net") > 0, "UP").when(F.col("flow_net") < 0, "DOWN").otherwise("NONE")
    plus = (has & (trend == way), (sp != "UNKNOWN") & (sp == F.col("direction")), vix == "NORMAL",
            flow == F.col("direction"), fr <= 0.65)
    minus = (has & (trend != way), (sp != "UNKNOWN") & (sp != F.col("direction")), vix == "HIGH",
             (flow != "NONE") & (flow != F.col("direction")), fr > 0.65)

    def points(conds) -> Column:
        out = F.lit(0)
        for c in conds:
            out = out + F.coalesce(c, F.lit(False)).cast("int")
        return out

    d = df.withColumns({"breakout": points(plus), "trap": points(minus)})
    b, t = F.col("breakout"), F.col("trap")
    tie = F.when((fr > 0.55) & F.col("gap_size").isin("LARGE", "EXTREME"), "TRAP").otherwise("UNCERTAIN")
    cls = F.when(b > t + 1, "BREAKOUT").when(t > b + 1, "TRAP").when(b == t, tie).otherwise("UNCERTAIN")
    return d.withColumns({"gap_class": cls, "wait_level": F.col("prev_close")})


def gap_recommendation() -> Column:
    cls, up = F.col("gap_class"), F.col("direction") == "UP"
    return (
        F.when((cls == "BREAKOUT") & up, "BUY_DIPS").when(cls == "BREAKOUT", "SHORT_BOUNCES")
        .when((cls == "TRAP") & up, "WAIT_FOR_FILL_BEFORE_LONG").when(cls == "TRAP", "WAIT_FOR_FILL_BEFORE_SHORT")
        .otherwise("WAIT_FOR_CONFIRMATION")
    )


# Tracked keyword -> canonical event and impact, first match wins.
TRACKED_EVENTS = [
    ("CPI", "US CPI", "HIGH"), ("Non-Farm", "NFP Payrolls", "HIGH"), ("Nonfarm", "NFP Payrolls", "HIGH"),
    ("FOMC", "FOMC Meeting", "HIGH"), ("Federal Funds", "FOMC Rate Decision", "HIGH"), ("GDP", "US GDP", "HIGH"),
    ("PCE", "US PCE Inflation", "HIGH"), ("Unemployment Claims", "Jobless Claims", "MEDIUM"),
    ("Retail Sales", "US Retail Sales", "MEDIUM"), ("ISM", "ISM PMI", "MEDIUM"), ("RBI", "RBI MPC Meeting", "HIGH"),
    ("India CPI", "India CPI", "HIGH"), ("India GDP", "India GDP", "HIGH"), ("India PMI", "India PMI", "MEDIUM"),
    ("OPEC", "OPEC Meeting", "HIGH"), ("ECB", "ECB Rate Decision", "HIGH"), ("BOE", "BoE Rate Decision", "HIGH"),
]


def calendar_match(df: DataFrame, rules: Sequence[tuple[str, str, str]] = TRACKED_EVENTS,
                   domestic: Sequence[str] = ("US", "USD"), as_of: Column | None = None, days: int = 14,
                   title: str = "event", date: str = "date", name_letters: int | None = None) -> DataFrame:
    """Canonical name and impact of high/medium events; unmatched high-impact domestic ones stay.

    With `as_of`, only the next `days` days are kept (a range filter that reaches the scan).
    """
    d = df
    if as_of is not None:
        d = d.filter(F.col(date).between(as_of, F.date_add(as_of, days)))
    d = d.withColumn("impact", F.upper("impact")).filter(F.col("impact").isin("HIGH", "MEDIUM"))
    low = F.lower(col(title))
    name = level = F.lit(None).cast("string")
    for kw, canonical, impact in reversed(rules):
        hit = low.contains(kw.lower())
        name, level = F.when(hit, canonical).otherwise(name), F.when(hit, impact).otherwise(level)
    keep = (F.col("impact") == "HIGH") & F.upper("country").isin(*domestic)
    d = d.withColumns({"_name": name, "_level": level}).filter(F.col("_name").isNotNull() | keep)
    return d.withColumns({
        "event_name": F.coalesce("_name", col(title) if name_letters is None else F.substring(col(title), 1, name_letters)),
        "impact": F.coalesce("_level", F.col("impact"))}).drop("_name", "_level")


IMPACT_ORDER = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}


def calendar_merge(events: DataFrame, order: Sequence[Column], title: str = "event", date: str = "date",
                   key_letters: int | None = None) -> DataFrame:
    """One row per (lower-case name, date), the first in `order`; key_letters compares only so many letters of it."""
    name = F.lower(col(title))
    keyed = events.withColumn("_k", name if key_letters is None else F.substring(name, 1, key_letters))
    out = first_per_key(keyed, ["_k", date], order).drop("_k")
    return out.withColumn("impact_rank", map_label("impact", IMPACT_ORDER, 9))
