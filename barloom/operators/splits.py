"""Order-preserving splits of long series with about equal row counts.

Rows are counted per key and time step on the map side. Running totals over the counts, first over coarse cells and then
inside each, place the cuts: a split ends where the total passes the next multiple of `most_rows`. A step that alone holds
more is cut again, at quantiles of the time inside it and, where a single instant holds more, of the tie column. So a key, an
hour or an instant with most of the rows is spread like the rest, and quiet stretches are not cut at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import stored

_STEPS = 3600  # steps in a coarse cell
_PARTS = 512  # quantiles of a crowded step
_LOW = -(1 << 63)


def micros(df: DataFrame, on: str) -> Column:
    """Order-preserving microseconds of a date, timestamp or timestamp without zone; the session's zone has no part in it."""
    kind, c = df.schema[on].dataType, F.col(on)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long") * 86_400_000_000
    if isinstance(kind, T.TimestampNTZType):
        second = F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
        return second * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_micros(c)


def _quantiles(x: Column, parts: Column) -> Column:
    """The parts - 1 inner quantiles of x in a group."""
    all_ = F.percentile_approx(x, F.array(*(F.lit(i / _PARTS) for i in range(1, _PARTS))), 10_000)
    wanted = F.sequence(F.lit(1), F.least(F.max(parts), F.lit(_PARTS)) - 1)
    some = F.transform(wanted, lambda i: F.element_at(all_, F.greatest(F.lit(1), F.floor(i * _PARTS / F.least(F.max(parts), F.lit(_PARTS))).cast("int"))))
    return F.when(F.max(parts) > 1, some)


def _crowded(rows: DataFrame, heavy: DataFrame, most_rows: int) -> DataFrame:
    """(_k, _s, _inner): cuts (time, tie) inside the steps that hold more than `most_rows`."""
    rows = rows.join(heavy.select("_k", "_s", "_n"), ["_k", "_s"])
    parts = F.ceil(F.col("_n") / most_rows).cast("int")
    by_time = rows.groupBy("_k", "_s").agg(_quantiles(F.col("_m"), parts).alias("q"))
    by_time = by_time.select("_k", "_s", F.explode("q").alias("m"), F.lit(_LOW).alias("t"))
    instants = rows.groupBy("_k", "_s", "_m").agg(F.count(F.lit(1)).alias("_i")).filter(F.col("_i") > most_rows)
    parts = F.ceil(F.col("_i") / most_rows).cast("int")
    by_tie = rows.join(instants, ["_k", "_s", "_m"]).groupBy("_k", "_s", "_m").agg(_quantiles(F.col("_t"), parts).alias("q"))
    by_tie = by_tie.select("_k", "_s", F.col("_m").alias("m"), F.explode("q").alias("t"))
    both = by_time.unionByName(by_tie)
    return both.groupBy("_k", "_s").agg(F.array_sort(F.collect_set(F.struct("m", "t"))).alias("_inner"))


def split_evenly(df: DataFrame, by: Sequence[str], on: str, tie: Column | None = None, most_rows: int = 1_000_000,
                 step: int = 1_000_000, out: str = "_split") -> DataFrame:
    """`df` with a long `out` that grows with (on, tie) inside each key; rows of one split number stand together.

    A split has at most about 2 * most_rows rows, beyond that only if one instant has them and there is no `tie` (a whole
    number). `df` is read twice, and twice more if a step of `step` microseconds is crowded: pass something cheap to read.
    Missing keys are a key; rows without a time come first.
    """
    key = F.struct(*(list(by) or [F.lit(0).alias("_")])).alias("_k")
    rows = df.select("*", key, micros(df, on).alias("_m"), (F.lit(0).cast("long") if tie is None else tie.cast("long")).alias("_t"))
    rows = rows.withColumn("_s", F.floor(F.col("_m") / step)).withColumn("_h", F.floor(F.col("_s") / _STEPS))
    steps = stored(rows.groupBy("_k", "_h", "_s").agg(F.count(F.lit(1)).alias("_n")), "steps")
    most = steps.groupBy("_k").agg(F.sum("_n").alias("total"), F.max("_n").alias("step")).agg(F.max("total"), F.max("step")).first()
    if (most[0] or 0) <= most_rows:  # no running total passes a multiple
        return df.withColumn(out, F.lit(0).cast("long"))
    before = Window.partitionBy("_k").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    hours = steps.groupBy("_k", "_h").agg(F.sum("_n").alias("_hn")).withColumn("_off", F.coalesce(F.sum("_hn").over(before), F.lit(0)))
    inside = Window.partitionBy("_k", "_h").orderBy("_s")
    run = F.coalesce(F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = steps.join(hours.select("_k", "_h", "_off"), ["_k", "_h"]).withColumn("_g", F.floor((F.col("_off") + run) / most_rows))
    first = F.lag("_g").over(inside)
    cuts = cells.filter("_h IS NOT NULL").withColumn("_last", first).filter(F.col("_last").isNull() | (F.col("_last") != F.col("_g")))
    cuts = cuts.groupBy("_k", "_h").agg(F.array_sort(F.collect_list(F.struct("_s", "_g"))).alias("_cuts"))  # a cell's steps at most
    placed = rows.join(cuts, ["_k", "_h"], "left")
    part = F.array_max(F.transform(F.filter("_cuts", lambda c: c["_s"] <= F.col("_s")), lambda c: c["_g"]))
    heavy = steps.filter(F.col("_n") > most_rows)
    inner = F.lit(0)
    if most[1] > most_rows:
        placed = placed.join(_crowded(rows, heavy, most_rows), ["_k", "_s"], "left")
        here = F.struct(F.col("_m").alias("m"), F.col("_t").alias("t"))
        inner = F.coalesce(F.size(F.filter("_inner", lambda c: c <= here)), F.lit(0))
    number = F.coalesce(F.shiftleft(part, 20) + inner, F.lit(-1).cast("long"))
    return placed.select(*df.columns, number.alias(out))
