"""Grouped aggregates over bars, returns and outcomes (AG)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalar import col


def mean_count_std(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(x).alias("mean"), F.count(x).alias("n"), F.stddev_samp(x).alias("std"))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson as an aggregate; missing (not an error) when a side is constant."""
    both = col(x).isNotNull() & col(y).isNotNull()
    px, py = F.when(both, col(x)), F.when(both, col(y))
    return F.try_divide(F.covar_samp(px, py), F.stddev_samp(px) * F.stddev_samp(py))


def conditional_mean(df: DataFrame, x: str, pred: Column, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(F.when(pred, F.col(x))).alias("mean_true"),
        F.avg(F.when(~pred, F.col(x))).alias("mean_false"),
        F.count_if(pred & F.col(x).isNotNull()).alias("n_true"),
    )


def weighted_mean(score: str | Column, weight: str | Column) -> Column:
    """sum(s*w)/sum(w): missing without rows, 0 when the weights add up to 0."""
    total = F.sum(F.when(col(score).isNotNull(), col(weight)))
    return F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(F.sum(col(score) * col(weight)), total))


def roll_up_bars(bars: DataFrame, period: Column, by: Sequence[str] = ("symbol",), date: str = "date") -> DataFrame:
    """OHLCV bars of a longer period; `period` labels the period of a row."""
    return bars.groupBy(*by, period.alias("period")).agg(
        F.min_by("open", date).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", date).alias("close"), F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("n_bars"))


def week_end(date: str = "date") -> Column:
    """Sunday that closes the Monday-Sunday week."""
    return F.date_add(F.trunc(date, "week"), 6)


def expectancy(outcomes: DataFrame, ret: str = "return_pct", sets=("asset", "horizon")) -> DataFrame:
    """Win rate, average win and loss and expectancy: overall, per asset and per horizon in one
    pass with grouping sets."""
    a, h = sets
    r = F.col(ret)
    out = outcomes.groupingSets([[], [a], [h]], a, h).agg(
        F.count(ret).alias("n"),
        F.count_if(r > 0).alias("wins"),
        F.avg(F.when(r > 0, r)).alias("avg_win"),
        F.avg(F.when(r < 0, r)).alias("avg_loss"),
        F.avg(r).alias("avg_return"),
    )
    rate = F.try_divide(F.col("wins"), F.col("n"))
    win, loss = F.coalesce("avg_win", F.lit(0.0)), F.coalesce("avg_loss", F.lit(0.0))
    return out.withColumns({"win_rate": rate * 100.0, "expectancy": rate * win + (1 - rate) * loss})


def tail_stats(df: DataFrame, ret: str, by: Sequence[str] = (), days: int = 252) -> DataFrame:
    std = F.stddev_samp(ret)
    return df.groupBy(*by).agg(
        F.avg(ret).alias("mean"), (std * math.sqrt(days)).alias("annual_vol"),
        F.max(ret).alias("best"), F.min(ret).alias("worst"),
        (F.try_divide(F.avg(ret), std) * math.sqrt(days)).alias("sharpe"))


def run_summary(yearly: DataFrame, by: Sequence[str] = ("symbol",), sharpe: str = "sharpe",
                bench: str = "bnh_sharpe") -> DataFrame:
    """Average Sharpe, years positive and years ahead of the benchmark."""
    return yearly.groupBy(*by).agg(
        F.avg(sharpe).alias("avg_sharpe"), F.count(F.lit(1)).alias("years"),
        F.count_if(F.col(sharpe) > 0).alias("years_positive"),
        F.count_if(F.col(sharpe) > F.col(bench)).alias("years_ahead"),
    ).withColumn("share_ahead", F.try_divide("years_ahead", "years"))
