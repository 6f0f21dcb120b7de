"""Signals: momentum, RSI, rate of change, filters, composite, labels, stability (SG)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.rolling import (
    carried, carried_back, diff, frame, lag, normalise_pm1, pct_change, row_no, sma,
)
from barloom.functions.scalar import clip, col, ladder, map_label
from barloom.operators.aggregate import roll_up_bars, week_end
from barloom.operators.smoothing import with_ewm

THRESHOLD = 0.15


def _sign(cond: Column, w: float) -> Column:
    """+w where the condition holds, else -w: a missing average counts as not above."""
    return F.when(cond, F.lit(w)).otherwise(F.lit(-w))


def momentum_score(bars: DataFrame, fast: int = 20, slow: int = 60, trend: int = 200) -> DataFrame:
    """Triple moving-average score in [-1, 1]; all three frames share one window operator."""
    m = bars.withColumns({"_f": sma("close", fast), "_s": sma("close", slow), "_t": sma("close", trend)})
    score = (_sign(F.col("close") > F.col("_f"), 0.33) + _sign(F.col("_f") > F.col("_s"), 0.33)
             + _sign(F.col("_s") > F.col("_t"), 0.34))
    return m.withColumn("score", F.round(score, 4)).drop("_f", "_s", "_t")


RSI_STEPS = [(">", 80.0, -1.0), (">", 70.0, -0.5), (">", 60.0, -0.1), (">=", 40.0, 0.0), (">=", 30.0, 0.1),
             (">=", 20.0, 0.5)]


def _rsi(bars: DataFrame, alpha: float, adjust: bool, min_periods: int, out: str) -> DataFrame:
    d = bars.withColumn("_d", diff("close"))
    d = d.withColumns({
        "_g": F.when(F.col("_d") > 0, F.col("_d")).otherwise(F.col("_d") * 0.0),
        "_l": F.when(F.col("_d") < 0, -F.col("_d")).otherwise(F.col("_d") * 0.0),
    })
    d = with_ewm(d, {"_ag": "_g", "_al": "_l"}, alpha, adjust, min_periods)
    rsi = 100.0 - 100.0 / (1.0 + F.col("_ag") / (F.col("_al") + 1e-10))
    return d.withColumn(out, rsi).drop("_d", "_g", "_l", "_ag", "_al")


def rsi(bars: DataFrame, span: int = 14, out: str = "rsi") -> DataFrame:
    """RSI from a recursive average with span `span`."""
    return _rsi(bars, 2.0 / (span + 1), False, 1, out)


def rsi_wilder(bars: DataFrame, n: int = 14, out: str = "rsi") -> DataFrame:
    """RSI with alpha 1/n and adjusted weights, missing before n changes."""
    return _rsi(bars, 1.0 / n, True, n, out)


def rsi_score(x: str | Column = "rsi") -> Column:
    return ladder(x, RSI_STEPS, 1.0, on_null=1.0)


def roc_score(bars: DataFrame, n: int = 10) -> DataFrame:
    r = bars.withColumn("_roc", pct_change("close", n) * 100.0)
    return r.withColumn("roc_score", normalise_pm1("_roc")).drop("_roc")


def vol_filter(vix: str | Column) -> Column:
    """0.5 below 20, 0 below 30, else -1; a missing reading counts as crisis."""
    return ladder(vix, [("<", 20.0, 0.5), ("<", 30.0, 0.0)], -1.0, on_null=-1.0)


# Score per asset class for (low inflation, growth), (high, growth), (high, none), (low, none).
QUADRANT_SCORES = {
    "equity": (1.0, -0.3, -1.0, -0.5),
    "gold": (0.0, 0.7, 1.0, 0.8),
    "crude": (0.5, 0.3, -0.5, -1.0),
}


def macro_quadrant_score(cpi_yoy: str | Column, growth: str | Column, asset_class: str) -> Column:
    high, good = col(cpi_yoy) > 3.0, col(growth) > 0
    a, b, c, d = QUADRANT_SCORES[asset_class]
    return F.when(~high & good, a).when(high & good, b).when(high, c).otherwise(d)


CURVE_STEPS = {
    "equity": ([(">", 1.0, 1.0), (">", 0.0, 0.3), (">", -0.5, -0.5)], -1.0),
    "gold": ([("<", 0.0, 0.8), ("<", 0.5, 0.3)], 0.0),
    "crude": ([(">", 0.0, 0.3)], -0.3),
}


def curve_score(spread: str | Column, asset_class: str) -> Column:
    steps, default = CURVE_STEPS[asset_class]
    return ladder(spread, steps, default)


def fx_score(df: DataFrame, fx: str, by=(), out: str = "fx_score") -> DataFrame:
    m = df.withColumn("_m", pct_change(fx, 20, by=by))
    return m.withColumn(out, -normalise_pm1("_m", by=by)).drop("_m")


SENTIMENT_FACTOR = {"equity": 2.0, "gold": -1.5, "crude": 1.0}


def sentiment_score(score: str | Column, asset_class: str) -> Column:
    return clip(col(score) * SENTIMENT_FACTOR[asset_class], -1, 1)


def composite(df: DataFrame, weights: Mapping[str, Column | float], backfill: bool = True,
              out: str = "score") -> DataFrame:
    """Weighted mean of component columns, each carried forward (and the head back-filled).

    `backfill` looks ahead at the head of a series; it is on for parity and can be switched off.
    """
    filled = {c: carried(c) for c in weights}
    d = df.withColumns(filled)
    if backfill:
        d = d.withColumns({c: F.coalesce(F.col(c), carried_back(c)) for c in weights})
    total, mass = F.lit(0.0), F.lit(0.0)
    for c, w in weights.items():
        w = w if isinstance(w, Column) else F.lit(float(w))
        total, mass = total + F.col(c) * w, mass + w
    return d.withColumn(out, clip(F.try_divide(total, mass), -1, 1))


def score_to_signal(score: str | Column, cut: float = THRESHOLD) -> Column:
    return ladder(score, [(">=", cut, "Long"), ("<=", -cut, "Short")], "Neutral", on_null="Neutral")


CONVICTION_STEPS = [(">=", 0.40, "HIGH"), (">=", 0.25, "MEDIUM"), (">=", 0.15, "LOW")]


def confidence(score: str | Column) -> Column:
    return ladder(F.abs(col(score)), CONVICTION_STEPS, "NONE", on_null="NONE")


def conviction(score: str | Column) -> Column:
    return ladder(F.abs(col(score)), [(">=", 0.50, "HIGH"), (">=", 0.30, "MEDIUM")], "LOW")


def stable_signal(df: DataFrame, label: str = "signal", n: int = 3, out: str = "stable") -> DataFrame:
    """Adopt a label only after n equal rows; until then keep the last stable one."""
    same = F.size(F.collect_set(label).over(frame(n))) == 1
    adopted = F.when((row_no() <= n) | same, F.col(label))
    return df.withColumn("_a", adopted).withColumn(out, carried("_a")).drop("_a")


def hit_rate(df: DataFrame, score: str = "score", close: str = "close", n: int = 60,
             cut: float = THRESHOLD, out: str = "hit_rate") -> DataFrame:
    """Share of active rows whose direction matched the next return, among the last n rows.

    The hit of a row is known one row later, so nothing looks ahead; the newest row counts as
    active but not as a hit, as its next return is missing.
    """
    s = F.col(score)
    d = df.withColumns({
        "_dir": F.when(s >= cut, 1).when(s <= -cut, -1).otherwise(0),
        "_ret": F.signum(pct_change(close)),
    })
    before = lag("_dir")
    known = F.when((before != 0) & (before == F.col("_ret")), 1).otherwise(0)
    d = d.withColumn("_hit", known)
    active = F.sum(F.when(F.col("_dir") != 0, 1).otherwise(0)).over(frame(n))
    hits = F.sum("_hit").over(frame(n - 1))
    rate = F.when((row_no() >= n) & (active > 0), hits / active).otherwise(F.lit(0.5))
    return d.withColumn(out, rate).drop("_dir", "_ret", "_hit")


def actionable(df: DataFrame) -> DataFrame:
    return df.filter((F.col("signal") != "Neutral") & (F.col("stable") == F.col("signal"))
                     & F.col("confidence").isin("HIGH", "MEDIUM"))


def legacy_signal(df: DataFrame, vix: str = "vix") -> DataFrame:
    """Price > MA20 > MA60 in a calm market is Long, the reverse or VIX > 30 Short."""
    m = df.withColumns({"_a": sma("close", 20), "_b": sma("close", 60)})
    up = (F.col("close") > F.col("_a")) & (F.col("_a") > F.col("_b")) & (F.col(vix) < 25)
    down = ((F.col("close") < F.col("_a")) & (F.col("_a") < F.col("_b"))) | (F.col(vix) > 30)
    return m.withColumn("signal", F.when(up, "Long").when(down, "Short").otherwise("Neutral")).drop("_a", "_b")


# Fast, slow, trend and RSI length per timeframe.
TIMEFRAMES = {"daily": (20, 60, 200, 14), "weekly": (10, 26, 52, 10), "monthly": (3, 6, 12, 6)}


def mtf_scores(bars: DataFrame) -> DataFrame:
    """Score and direction per symbol, timeframe and period."""
    from barloom.operators.ranking import union_all

    parts = []
    for tf, (fast, slow, trend, n) in TIMEFRAMES.items():
        if tf == "daily":
            b = bars.select("symbol", "date", "close")
        else:
            label = week_end() if tf == "weekly" else F.last_day("date")
            b = roll_up_bars(bars, label).select("symbol", F.col("period").alias("date"), "close")
        b = rsi_wilder(b.withColumns({
            "_f": sma("close", fast), "_s": sma("close", slow), "_t": sma("close", trend), "_rn": row_no()}), n)
        score = (_sign(F.col("close") > F.col("_f"), 0.25) + _sign(F.col("_f") > F.col("_s"), 0.25)
                 + _sign(F.col("_s") > F.col("_t"), 0.25)
                 + F.when(F.col("rsi") > 60, 0.25).when(F.col("rsi") < 40, -0.25).otherwise(0.0))
        ready = (F.col("_rn") >= trend + 5) & F.col("_t").isNotNull() & F.col("rsi").isNotNull()
        parts.append(b.select("symbol", F.lit(tf).alias("timeframe"), "date",
                              F.when(ready, score).alias("score"), "rsi"))
    out = union_all(*parts)
    way = ladder("score", [(">=", 0.20, "LONG"), ("<=", -0.20, "SHORT")], "NEUTRAL", on_null="NEUTRAL")
    return out.withColumn("direction", way)


def mtf_confirm(d: str = "daily", w: str = "weekly", m: str = "monthly") -> tuple[Column, Column]:
    """(status, overall) from the three directions."""
    d, w, m = (F.col(x) for x in (d, w, m))

    def count(way: str) -> Column:
        return sum((F.when(x == way, 1).otherwise(0) for x in (d, w, m)), F.lit(0))

    status = (
        F.when(((d == "SHORT") & (m == "LONG")) | ((d == "LONG") & (m == "SHORT")), "CONFLICTED")
        .when((d == w) & (w == m) & (d != "NEUTRAL"), "THREE_WAY_CONFIRMED")
        .when((count("LONG") >= 2) | (count("SHORT") >= 2), "TWO_WAY_CONFIRMED")
        .when(count("NEUTRAL") == 3, "NEUTRAL").otherwise("CONFLICTED")
    )
    confirmed = status.isin("THREE_WAY_CONFIRMED", "TWO_WAY_CONFIRMED")
    overall = F.when(confirmed, F.when(count("LONG") > count("SHORT"), "LONG").otherwise("SHORT")).otherwise("NO TRADE")
    return status, overall


# Component weights per asset.
COMPONENTS = ("ma", "rsi_s", "roc", "vol", "macro", "curve", "fx")
ASSET_WEIGHTS = {
    "NIFTY": (0.20, 0.15, 0.10, 0.20, 0.20, 0.10, 0.05),
    "SP500": (0.20, 0.15, 0.10, 0.25, 0.20, 0.10, 0.0),
    "Gold": (0.20, 0.15, 0.10, 0.15, 0.25, 0.10, 0.05),
    "Silver": (0.20, 0.15, 0.10, 0.15, 0.25, 0.10, 0.05),
    "Crude": (0.20, 0.15, 0.10, 0.15, 0.25, 0.10, 0.05),
}
ASSET_CLASS = {"NIFTY": "equity", "SP500": "equity", "Gold": "gold", "Silver": "gold", "Crude": "crude"}
FX_FACTOR = {"NIFTY": 1.0, "SP500": 0.0, "Gold": 1.0, "Silver": 1.0, "Crude": 0.5}


def by_class(columns: Mapping[str, Column | str], cls: str = "asset_class") -> Column:
    """Pick the column that belongs to the row's asset class."""
    out = F.lit(None).cast("double")
    for name, c in columns.items():
        out = F.when(F.col(cls) == name, col(c)).otherwise(out)
    return out


# Weight of the sentiment score, and the factor of the assets that take it.
SENTIMENT_WEIGHT = 0.05
SENTIMENT_OF = {"NIFTY": "equity", "SP500": "equity", "Gold": "gold"}


def sentiment_term(score: str | Column, asset: str = "asset") -> Column:
    """What the sentiment score adds to an asset's composite; nothing for assets without one or where it is missing."""
    out = F.lit(0.0)
    for name, cls in SENTIMENT_OF.items():
        out = F.when(F.col(asset) == name, F.coalesce(sentiment_score(score, cls), F.lit(0.0))).otherwise(out)
    return SENTIMENT_WEIGHT * out


def asset_composite(components: DataFrame, backfill: bool = True, sentiment: str | None = None) -> DataFrame:
    """Composite of the seven components with the weights of the row's `asset`, plus the term of the `sentiment` column."""
    weights = {
        c: map_label("asset", {a: ws[i] for a, ws in ASSET_WEIGHTS.items()}, 0.0) for i, c in enumerate(COMPONENTS)
    }
    out = composite(components, weights, backfill)
    return out if sentiment is None else out.withColumn("score", clip(F.col("score") + sentiment_term(sentiment), -1, 1))
