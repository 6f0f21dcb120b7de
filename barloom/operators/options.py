"""Option-chain operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import col, ladder


def strike_pain(chain: DataFrame, by: Sequence[str] = ("expiry",)) -> DataFrame:
    """Writers' loss if the market settles at each listed strike.

    Prefix sums over the strikes replace the strike-against-strike comparison:
    loss = s*sum(oi) - sum(k*oi) over calls below s, and the mirror image over puts above s.
    The chain is first summed per strike, so a window partition holds the listed strikes only.
    """
    ce, pe = (F.col("opt_type") == t for t in ("CE", "PE"))
    per = chain.groupBy(*by, "strike").agg(
        F.sum(F.when(ce, F.col("oi")).otherwise(0.0)).alias("c"),
        F.sum(F.when(ce, F.col("oi") * F.col("strike")).otherwise(0.0)).alias("ck"),
        F.sum(F.when(pe, F.col("oi")).otherwise(0.0)).alias("p"),
        F.sum(F.when(pe, F.col("oi") * F.col("strike")).otherwise(0.0)).alias("pk"),
    )
    listed = Window.partitionBy(*by)
    running = listed.orderBy("strike").rowsBetween(Window.unboundedPreceding, 0)

    def upto(x: str) -> Column:  # the candidate strike itself adds nothing to either side
        return F.sum(x).over(running)

    def beyond(x: str) -> Column:
        return F.sum(x).over(listed) - F.sum(x).over(running)

    pain = F.col("strike") * upto("c") - upto("ck") + beyond("pk") - F.col("strike") * beyond("p")
    return per.withColumn("pain", pain).select(*by, "strike", "pain")


PAIN_NEAR, PAIN_MED = 1.5, 3.0


def pain_bias(dev: str | Column) -> Column:
    d = F.col(dev) if isinstance(dev, str) else dev
    return (
        F.when(F.abs(d) < PAIN_NEAR, "NEUTRAL")
        .when(d > PAIN_MED, "BULLISH_GRAVITATE")
        .when(d < -PAIN_MED, "BEARISH_GRAVITATE")
        .when(d > 0, "MILDLY_BULLISH")
        .otherwise("MILDLY_BEARISH")
    )


def max_pain(chain: DataFrame, spot: float | Column, by: Sequence[str] = ("expiry",)) -> DataFrame:
    """Strike with the smallest loss; the lower strike wins a tie."""
    spot = F.lit(spot) if not isinstance(spot, Column) else spot
    best = strike_pain(chain, by).groupBy(*by).agg(
        F.min(F.struct("pain", "strike")).alias("_m"))
    dev = (F.col("max_pain_strike") - spot) / spot * 100.0
    out = best.select(*by, F.col("_m.strike").alias("max_pain_strike"), F.col("_m.pain").alias("pain"))
    return out.withColumn("deviation_pct", dev).withColumn("bias", pain_bias("deviation_pct"))


def pcr(chain: DataFrame, by: Sequence[str] = ("expiry",)) -> DataFrame:
    """Put/call ratio by open interest and by volume."""
    ce, pe = (F.col("opt_type") == t for t in ("CE", "PE"))
    sums = chain.groupBy(*by).agg(
        F.sum(F.when(ce, F.col("oi")).otherwise(0.0)).alias("ce_oi"),
        F.sum(F.when(pe, F.col("oi")).otherwise(0.0)).alias("pe_oi"),
        F.sum(F.when(ce, F.col("vol")).otherwise(0.0)).alias("ce_vol"),
        F.sum(F.when(pe, F.col("vol")).otherwise(0.0)).alias("pe_vol"),
    )
    return sums.withColumns({
        "pcr_oi": F.coalesce(F.try_divide("pe_oi", "ce_oi"), F.lit(0.0)),
        "pcr_vol": F.coalesce(F.try_divide("pe_vol", "ce_vol"), F.lit(0.0)),
    })


# The two put/call ladders.
PCR_NEAR_STEPS = [
    (">=", 1.40, "EXTREME_BULLISH"), (">=", 1.20, "BULLISH"),
    ("<=", 0.60, "EXTREME_BEARISH"), ("<=", 0.80, "BEARISH"),
]
PCR_ALL_STEPS = [
    (">", 1.20, "CONTRARIAN_BULLISH"), (">", 1.0, "MILDLY_BULLISH"),
    ("<", 0.70, "CONTRARIAN_BEARISH"), ("<", 0.9, "MILDLY_BEARISH"),
]


def pcr_label(x: str | Column, steps=PCR_NEAR_STEPS) -> Column:
    return ladder(x, steps, "NEUTRAL", on_null="UNKNOWN")


def nearest_expiry(chain: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of the nearest expiry (per `by` group), by a semi join on the minimum."""
    near = chain.groupBy(*by).agg(F.min("expiry").alias("expiry"))
    return chain.join(near, [*by, "expiry"], "left_semi")


SKEW_HIGH, SKEW_LOW = 1.20, 0.80


def skew_ratio(chain: DataFrame, spot: float, width_pct: float = 2.0, price: str | Column | None = None,
               by: Sequence[str] = ("expiry",)) -> DataFrame:
    """Average put price just below spot over average call price just above it.

    The price is the close, else the last price (close_px, last_px), unless another column is given.
    """
    k = F.col("strike")
    value = F.coalesce("close_px", "last_px") if price is None else col(price)
    put = (F.col("opt_type") == "PE") & (k >= spot * (1 - width_pct / 100)) & (k < spot)
    call = (F.col("opt_type") == "CE") & (k <= spot * (1 + width_pct / 100)) & (k > spot)
    avgs = chain.groupBy(*by).agg(
        F.avg(F.when(put, value)).alias("avg_put"),
        F.avg(F.when(call, value)).alias("avg_call"),
    ).withColumn("skew_ratio", F.try_divide("avg_put", "avg_call"))
    label = (
        F.when(F.col("avg_put").isNull() | F.col("avg_call").isNull(), "INSUFFICIENT_STRIKES")
        .when(F.col("skew_ratio").isNull(), "UNAVAILABLE")
        .when(F.col("skew_ratio") >= SKEW_HIGH, "ELEVATED_PUT_DEMAND")
        .when(F.col("skew_ratio") <= SKEW_LOW, "ELEVATED_CALL_DEMAND")
        .otherwise("BALANCED")
    )
    return avgs.withColumn("skew_signal", label)


# Contribution of each option reading to the composite.
PCR_SCORE = {"EXTREME_BULLISH": 0.35, "BULLISH": 0.20, "NEUTRAL": 0.0, "BEARISH": -0.20, "EXTREME_BEARISH": -0.35}
PAIN_SCORE = {"BULLISH_GRAVITATE": 0.30, "MILDLY_BULLISH": 0.15, "NEUTRAL": 0.0,
              "MILDLY_BEARISH": -0.15, "BEARISH_GRAVITATE": -0.30}
SKEW_SCORE = {"ELEVATED_PUT_DEMAND": -0.20, "BALANCED": 0.0, "ELEVATED_CALL_DEMAND": 0.20}
IV_SCORE = {"COMPRESSED": -0.10, "NORMAL": 0.0, "ELEVATED": -0.05, "CRISIS": 0.10}
IV_STEPS = [(">", 30.0, "CRISIS"), (">", 20.0, "ELEVATED"), (">", 12.0, "NORMAL")]
COMPOSITE_STEPS = [
    (">=", 0.40, "STRONG_BULLISH"), (">=", 0.15, "BULLISH"),
    ("<=", -0.40, "STRONG_BEARISH"), ("<=", -0.15, "BEARISH"),
]


def options_composite(df: DataFrame) -> DataFrame:
    """Sum of the four contributions from pcr_signal, bias, skew_signal, iv_regime, with label."""
    from barloom.functions.scalar import clip, map_label

    total = (map_label("pcr_signal", PCR_SCORE, 0.0) + map_label("bias", PAIN_SCORE, 0.0)
             + map_label("skew_signal", SKEW_SCORE, 0.0) + map_label("iv_regime", IV_SCORE, 0.0))
    d = df.withColumn("composite", F.round(clip(total, -1, 1), 4))
    return d.withColumn("composite_signal", ladder("composite", COMPOSITE_STEPS, "NEUTRAL"))
