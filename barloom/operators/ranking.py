"""Latest-per-key, top-k, dedupe and set operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in `order`.

    `rn <= 1` lets Spark add a WindowGroupLimit before the shuffle, so a hot key sends at most
    one row per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 1").drop("_rn")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def latest_per_key(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Latest row per key as an aggregate, combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(date)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def label_share(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Count and percentage per label; the window runs on the aggregated rows only."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    out = first
    for other in others:
        out = out.unionByName(other)
    return out
