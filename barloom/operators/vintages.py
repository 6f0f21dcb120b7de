"""As-of joins of series that are published late and revised (AL, JN).

A value has a period it describes and an instant it becomes known. A row may use what was known by its own time: of the
newest period published by then, the latest print. That is a running maximum of (period, published) in order of
publication, and maxima compose, so each bucket of time is settled alone and one row per key and bucket carries the
maximum on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.align import by_year
from barloom.operators.splits import split_evenly


def known_asof(left: DataFrame, prints: DataFrame, values: Sequence[str], by: Sequence[str] = ("symbol",), on: str = "date",
               period: str = "period", published: str = "published", bucket: Callable[[Column], Column] = by_year,
               most_rows: int | None = None, keep_period: str | None = None) -> DataFrame:
    """Attach to each left row the values of the newest period that was published by its time, as last revised by then.

    A revision of an older period that is published later does not displace a newer period. Prints of one period and one
    instant are settled by the greatest values. Prints without key, period or instant are unknown; left rows without a
    time or before the first print get nulls, repeated left rows stay. `on` and `published` are of one type. Buckets are
    of time, or with `most_rows` of about that many rows (the sides are then read twice).
    """
    rest = [c for c in left.columns if c not in by and c != on]
    r = prints.na.drop(subset=[*by, period, published])
    best = F.struct(F.col(period).alias("_p"), F.col(published).alias("_t"), *[F.col(v) for v in values])
    r = r.select(*by, F.col(published).alias(on), best.alias("_v"))
    l = left.select(*by, on, F.struct(*(rest or [on])).alias("_l"))
    both = l.withColumns({"_v": F.lit(None).cast(r.schema["_v"].dataType), "_side": F.lit(1)}).unionByName(
        r.withColumns({"_l": F.lit(None).cast(l.schema["_l"].dataType), "_side": F.lit(0)}))
    if most_rows:
        first = F.lit(-(1 << 62))  # prints of an instant stand before its left rows
        tie = F.when(F.col("_side") == 0, first).otherwise(F.pmod(F.xxhash64("_l"), F.lit(1 << 40)))
        both = split_evenly(both, by, on, tie, most_rows, out="_b")
        bucket = lambda _: F.col("_b")
    key = F.struct(*by, bucket(F.col(on)).alias("_b")).alias("_k")
    both = both.select(on, "_l", "_v", "_side", key).repartition("_k")

    ends = both.groupBy("_k").agg(F.max("_v").alias("_v"), F.count("_l").alias("_nl"))
    before = Window.partitionBy(*[F.col(f"_k.{c}") for c in by]).orderBy("_k._b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("_c", F.max("_v").over(before)).filter("_nl > 0").select("_k", "_c")

    running = Window.partitionBy("_k").orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_m", F.max("_v").over(running)).filter("_side = 1")
    out = seen.join(carry, "_k", "left").withColumn("_m", F.greatest("_m", "_c"))
    taken = [F.col(f"_m.{v}").alias(v) for v in values]
    if keep_period:
        taken.append(F.col("_m._p").alias(keep_period))
    return out.select(*[F.col(f"_k.{c}").alias(c) for c in by], on, *[F.col(f"_l.{c}").alias(c) for c in rest], *taken)
