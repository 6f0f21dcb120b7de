"""Institutional flows and futures positioning (FL, PO)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import cumulative, lag, pct_le_full, pct_le_tail
from barloom.functions.scalar import ladder, map_label


def streaks(flows: DataFrame, net: str = "net", by: tuple[str, ...] = (), date: str = "date") -> DataFrame:
    """Length of the current run of days with the same flow direction."""
    way = F.when(F.col(net) >= 0, "BUY").otherwise("SELL")
    d = flows.withColumn("direction", way)
    prev = lag("direction", by=by, order=date)
    start = F.when(prev.isNull() | (prev != F.col("direction")), 1).otherwise(0)
    i = d.withColumn("_s", start).withColumn("_i", F.sum("_s").over(cumulative(by, date)))
    run = Window.partitionBy(*by, "_i").orderBy(date)
    return i.withColumn("streak", F.row_number().over(run)).drop("_s", "_i")


def streak_signal(df: DataFrame, long_run: int = 5, heavy: float = 5000.0, net: str = "net") -> DataFrame:
    buy, n, x = F.col("direction") == "BUY", F.col("streak"), F.col(net)
    label = (
        F.when(n >= long_run, F.when(buy, "BULLISH").otherwise("BEARISH"))
        .when(n >= 3, F.when(buy, "MILD_BULLISH").otherwise("MILD_BEARISH"))
        .when(x < -heavy, "WEAK_BEARISH").when(x > heavy, "WEAK_BULLISH").otherwise("NEUTRAL")
    )
    return df.withColumn("flow_signal", label)


# Fixed values.
COT_STEPS = [(">=", 80.0, "CONTRARIAN_BEARISH"), ("<=", 20.0, "CONTRARIAN_BULLISH"),
             (">=", 60.0, "MILDLY_BEARISH"), ("<=", 40.0, "MILDLY_BULLISH")]


def cot_percentile(positions: DataFrame, by: str = "contract", history: int | None = 520) -> DataFrame:
    """Net position, its share of history at or below, and the contrarian label.

    History: the last `history` rows up to the row; None is the full sample, for the newest row only (it looks ahead).
    """
    p = positions.withColumn("net", F.col("long") - F.col("short"))
    p = p.withColumn("pct", (pct_le_full("net", by=by) if history is None else pct_le_tail("net", history, by=by)) * 100.0)
    return p.withColumn("signal", ladder("pct", COT_STEPS, "NEUTRAL"))


# Regime and flow combination -> index adjustment.
FLOW_ADJUST = {
    "INDIA_GOLDILOCKS_FII_BUY": 0.15, "INDIA_GOLDILOCKS_FII_SELL": 0.05, "INDIA_GOLDILOCKS_FII_NEUTRAL": 0.10,
    "INDIA_OVERHEATING": 0.0, "INDIA_SLOWDOWN": -0.05, "INDIA_STAGFLATION": -0.20,
}


def flow_direction(net: str | Column) -> Column:
    x = F.col(net) if isinstance(net, str) else net
    return F.when(x > 0, "BUY").when(x < 0, "SELL").otherwise("NEUTRAL")


def flow_regime_combo(df: DataFrame, regime: str = "regime", net: str = "net") -> DataFrame:
    """Regime x flow direction -> key -> adjustment; an unlisted regime counts as overheating."""
    r = F.col(regime)
    key = (
        F.when(r == "INDIA_GOLDILOCKS", F.concat(r, F.lit("_FII_"), flow_direction(net)))
        .when(r.isin("INDIA_STAGFLATION", "INDIA_OVERHEATING", "INDIA_SLOWDOWN"), r)
        .otherwise("INDIA_OVERHEATING")
    )
    return df.withColumn("signal_key", key).withColumn("adjustment", map_label("signal_key", FLOW_ADJUST, 0.0))
