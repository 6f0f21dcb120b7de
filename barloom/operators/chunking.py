"""Window computations over series that are too long for one task (ticks).

A series is numbered without a global sort: rows are counted per coarse time bucket, the bucket
counts (few rows) are summed up in order, and each bucket numbers its own rows. Chunks of equal
row count then become the window partitions; the last `lookback` rows of a chunk are copied into
the next one, so each frame is complete. A key that holds a third of all rows is spread over as
many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _offsets(df: DataFrame, keys: Sequence[str], total: Column) -> DataFrame:
    """Sum of `total` over all earlier buckets of the key; one row per key and bucket."""
    per_bucket = df.groupBy(*keys, "_b").agg(total.alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.select(*keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                out: str = "rn") -> DataFrame:
    """Row number within the key, computed bucket by bucket."""
    b = df.withColumn("_b", bucket)
    offsets = _offsets(b, keys, F.count(F.lit(1)))
    local = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    return b.join(offsets, [*keys, "_b"]).withColumn(out, F.col("_off") + local).drop("_b", "_off")


def running_total(df: DataFrame, x: str, keys: Sequence[str], order: Sequence[str], bucket: Column,
                  out: str = "running") -> DataFrame:
    """Running sum of x within the key: a running sum per bucket plus the buckets before it."""
    b = df.withColumn("_b", bucket)
    offsets = _offsets(b, keys, F.sum(x))
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = b.join(offsets, [*keys, "_b"])
    return joined.withColumn(out, F.col("_off") + F.sum(x).over(w)).drop("_b", "_off")


def chunked(df: DataFrame, lookback: int, keys: Sequence[str], order: Sequence[str], bucket: Column,
            chunk_rows: int = 1_000_000) -> DataFrame:
    """Add `_chunk` (window key) and `_halo` (rows copied in from the chunk before)."""
    chunk_rows = max(chunk_rows, lookback)  # the rows copied in come from one chunk
    n = number_rows(df, keys, order, bucket, "_rn")
    own = F.floor((F.col("_rn") - 1) / chunk_rows)
    tail = (F.col("_rn") - 1) % chunk_rows >= chunk_rows - lookback
    places = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    placed = n.withColumn("_own", own).withColumn("_chunk", F.explode(places))
    return placed.withColumn("_halo", F.col("_chunk") != F.col("_own")).drop("_own")


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_halo")).drop("_chunk", "_halo", "_rn")
