"""Alignment and as-of joins (AL, JN)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import carried, carried_back, lead, ordered
from barloom.operators.splits import split_evenly


def by_year(x: Column) -> Column:
    return F.year(x)


def panel(bars: DataFrame, names: Mapping[str, str], value: str = "close",
          date: str = "date", key: str = "symbol") -> DataFrame:
    """Wide panel: one column per listed series, one row per date.

    The list of series is given, so the pivot is one aggregation without a pass that collects
    the distinct keys on the driver.
    """
    picks = [F.max(F.when(F.col(key) == sym, F.col(value))).alias(name) for sym, name in names.items()]
    return bars.groupBy(date).agg(*picks)


def align_inner(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep the dates on which every series has a value."""
    return wide.na.drop(subset=list(names))


def align_ffill(wide: DataFrame, names: Sequence[str], by: Sequence[str] = (),
                date: str = "date") -> DataFrame:
    """Carry each series forward, then drop the head in which one is still missing.

    A panel has one row per calendar day, which bounds the window partition.
    """
    filled = wide.withColumns({n: carried(n, by=by, order=date) for n in names})
    return filled.na.drop(subset=list(names))


def asof_join(left: DataFrame, right: DataFrame, values: Sequence[str], by: Sequence[str] = ("symbol",),
              on: str = "date", direction: str = "backward",
              bucket: Callable[[Column], Column] = by_year, allow_equal: bool = True,
              keep_time: str | None = None, most_rows: int | None = None) -> DataFrame:
    """Attach the last right row with right.on <= left.on (or the first with >= if forward).

    Both sides are cut into order-preserving buckets: of time, or with `most_rows` splits of about that many rows wherever
    the rows are (the sides are then read twice). A small table (one row per key and bucket)
    carries the last known right row across bucket borders; inside a bucket a window over the
    union finds the match. A key that holds most of the rows is thus split over its buckets, and
    no row is paired with more than one other. `right` must be unique on (by, on).
    """
    back = direction == "backward"
    payload = F.struct(F.col(on).alias("_t"), *[F.col(v) for v in values])
    rest = [c for c in left.columns if c not in by and c != on]
    r = right.select(*by, F.col(on), payload.alias("_v"))
    l = left.select(*by, on, F.struct(*(rest or [on])).alias("_l"))
    both = l.withColumns({"_v": F.lit(None).cast(r.schema["_v"].dataType), "_side": F.lit(1)}).unionByName(
        r.withColumns({"_l": F.lit(None).cast(l.schema["_l"].dataType), "_side": F.lit(0 if allow_equal else 2)}))
    # One shuffle on a struct key serves both branches below, so each input is computed once (plain
    # key columns would get a not-null filter from the join in one branch only).
    if most_rows:
        # a right row meets the left rows of its instant whichever split they are in
        end = F.lit((1 << 62) * (-1 if back == allow_equal else 1))
        tie = F.when(F.col("_side") != 1, end).otherwise(F.pmod(F.xxhash64("_l"), F.lit(1 << 40)))
        both = split_evenly(both, by, on, tie, most_rows, out="_b")
        bucket = lambda _: F.col("_b")
    key = F.struct(*by, bucket(F.col(on)).alias("_b")).alias("_k")
    both = both.select(on, "_l", "_v", "_side", key).repartition("_k")

    pick = F.max_by if back else F.min_by
    known = F.when(F.col("_side") != 1, F.col(on))
    ends = both.groupBy("_k").agg(pick("_v", known).alias("_v"), F.count("_l").alias("_nl"))
    step = F.col("_k._b").asc() if back else F.col("_k._b").desc()
    before = Window.partitionBy(*[F.col(f"_k.{c}") for c in by]).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("_c", F.last("_v", ignorenulls=True).over(before)).filter("_nl > 0").select("_k", "_c")

    way = F.col(on).asc() if back else F.col(on).desc()
    w = (
        Window.partitionBy("_k").orderBy(way, "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = both.withColumn("_m", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    out = seen.join(carry, "_k", "left").withColumn("_m", F.coalesce("_m", "_c"))
    picked = [F.col(f"_l.{c}").alias(c) for c in rest]
    taken = [F.col(f"_m.{v}").alias(v) for v in values]
    if keep_time:
        taken.append(F.col("_m._t").alias(keep_time))
    return out.select(*[F.col(f"_k.{c}").alias(c) for c in by], on, *picked, *taken)


def asof_ffill_bfill(left: DataFrame, right: DataFrame, values: Sequence[str], **kw) -> DataFrame:
    """Backward as-of, the head filled from the first later value (looks ahead)."""
    back = asof_join(left, right, values, **kw)
    ahead = asof_join(back, right.withColumnsRenamed({v: f"_f_{v}" for v in values}),
                      [f"_f_{v}" for v in values], direction="forward", **kw)
    filled = {v: F.coalesce(F.col(v), F.col(f"_f_{v}")) for v in values}
    return ahead.withColumns(filled).drop(*[f"_f_{v}" for v in values])


def nearest_asof(left: DataFrame, right: DataFrame, values: Sequence[str], on: str = "date", **kw) -> DataFrame:
    """Exact date, else the nearest one; on equal distance the earlier date wins."""
    back = asof_join(left, right, values, on=on, keep_time="_bt", **kw)
    ahead = asof_join(back, right.withColumnsRenamed({v: f"_f_{v}" for v in values}),
                      [f"_f_{v}" for v in values], on=on, direction="forward", keep_time="_ft", **kw)
    use_back = F.col("_ft").isNull() | (
        F.col("_bt").isNotNull()
        & (F.datediff(F.col(on), F.col("_bt")) <= F.datediff(F.col("_ft"), F.col(on)))
    )
    out = {v: F.when(use_back, F.col(v)).otherwise(F.col(f"_f_{v}")) for v in values}
    out["matched_date"] = F.when(use_back, F.col("_bt")).otherwise(F.col("_ft"))
    return ahead.withColumns(out).drop("_bt", "_ft", *[f"_f_{v}" for v in values])


def nth_bar_after(events: DataFrame, bars: DataFrame, n: int | Sequence[int], value: str = "close",
                  by: str = "symbol", date: str = "date", out: str = "price_after") -> DataFrame:
    """Value n bars strictly after each event date: bar numbers, then an equi join.

    With several n, one row per event and n (column `horizon`) from a single as-of join.
    """
    numbered = bars.select(by, date, value, F.row_number().over(ordered(by, date)).alias("_n"))
    at = asof_join(events, numbered.select(by, date, "_n"), ["_n"], by=(by,), on=date)
    many = not isinstance(n, int)
    steps = F.array(*[F.lit(k) for k in (n if many else [n])])
    at = at.withColumn("horizon", F.explode(steps))
    at = at.withColumn("_n", F.coalesce("_n", F.lit(0)) + F.col("horizon"))
    target = numbered.select(by, "_n", F.col(date).alias("outcome_date"), F.col(value).alias(out))
    joined = at.join(target, [by, "_n"], "left").drop("_n")
    return joined if many else joined.drop("horizon")


def upsample_ffill(series: DataFrame, by: Sequence[str] = ("series_id",), date: str = "date") -> DataFrame:
    """Lower-frequency series -> one row per calendar day up to the next observation."""
    nxt = series.withColumn("_next", lead(date, 1, by=by, order=date))
    last = F.coalesce(F.date_sub("_next", 1), F.col(date))
    days = nxt.withColumn("_d", F.explode(F.sequence(F.col(date), last)))
    return days.withColumn(date, F.col("_d")).drop("_d", "_next")


def upsample_linear(series: DataFrame, values: Sequence[str] = ("value",), by: Sequence[str] = ("series_id",),
                    date: str = "date") -> DataFrame:
    """As `upsample_ffill`, with linear interpolation between observations."""
    w = {"by": by, "order": date}
    ahead = {f"_n_{v}": lead(v, 1, **w) for v in values}
    nxt = series.withColumns({"_next": lead(date, 1, **w), **ahead})
    last = F.coalesce(F.date_sub("_next", 1), F.col(date))
    days = nxt.withColumn("_d", F.explode(F.sequence(F.col(date), last)))
    share = F.datediff("_d", date) / F.datediff("_next", date)
    filled = {
        v: F.when(F.col("_next").isNull(), F.col(v)).otherwise(
            F.col(v) + (F.col(f"_n_{v}") - F.col(v)) * share)
        for v in values
    }
    return days.withColumns({**filled, date: F.col("_d")}).drop("_d", "_next", *ahead)


def weekday_grid(bounds: DataFrame, start: str = "start", end: str = "end", date: str = "date") -> DataFrame:
    """Monday-Friday calendar between the bounds in each row."""
    days = bounds.withColumn(date, F.explode(F.sequence(F.col(start), F.col(end))))
    return days.filter(F.weekday(date) < 5).drop(start, end)


def backfill(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("symbol",), date: str = "date") -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), carried_back(c, by=by, order=date)) for c in cols})
