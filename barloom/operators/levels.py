"""Price levels: swing points, support and resistance, entry zones (WN-20/21, LV)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.rolling import lag, ordered, rolling, rolling_std, sma, whole
from barloom.operators.order_stats import next_above


def swing_points(bars: DataFrame, value: str = "close", back: int = 5, ahead: int = 4, edge: int = 5,
                 by: str = "symbol", date: str = "date") -> DataFrame:
    """Flag rows equal to the max/min of rows i-back … i+ahead, away from both ends of the series."""
    o = ordered(by, date)
    w = o.rowsBetween(-back, ahead)
    rn, n = F.row_number().over(o), F.count(F.lit(1)).over(whole(by))
    inner = (rn > edge) & (rn <= n - edge)
    return bars.withColumns({
        "swing_high": inner & (F.col(value) == F.max(value).over(w)),
        "swing_low": inner & (F.col(value) == F.min(value).over(w)),
    })


def nearest_levels(bars: DataFrame, value: str = "close", by: str = "symbol", date: str = "date",
                   lookback: int = 252) -> DataFrame:
    """Nearest swing high above and swing low below the latest price, else the range extreme.

    The latest row per symbol is attached by a window, so one pass over the series is enough.
    """
    desc = F.row_number().over(ordered(by, date).partitionBy(by).orderBy(F.col(date).desc()))
    marked = swing_points(bars, value, by=by, date=date).withColumns({
        "_desc": desc, "_cur": F.max_by(value, date).over(whole(by))})
    cur = F.col("_cur")
    out = marked.groupBy(by).agg(
        F.max("_cur").alias("current"),
        F.min(F.when(F.col("swing_high") & (F.col(value) > cur), F.col(value))).alias("_r"),
        F.max(F.when(F.col("swing_low") & (F.col(value) < cur), F.col(value))).alias("_s"),
        F.max(F.when(F.col("_desc") <= lookback, F.col(value))).alias("_hi"),
        F.min(F.when(F.col("_desc") <= lookback, F.col(value))).alias("_lo"),
    )
    return out.select(by, "current", F.coalesce("_r", "_hi").alias("nearest_resistance"),
                      F.coalesce("_s", "_lo").alias("nearest_support"))


def next_above_known(points: DataFrame, queries: DataFrame, by: Sequence[str], most_rows: int = 100_000) -> DataFrame:
    """(by, x, at, above) of each distinct query (by, x, at): the smallest value above x among the points (by, value, known) of
    its key with known <= at; queries without one are left out.

    Points are cut into buckets of value, of about `most_rows` points each, that also tell when their first point was known.
    The answer is in the query's own bucket or in the first bucket above it with a point known by then, so a query meets two
    buckets at most, and in each a wavelet matrix answers all queries at once. Tasks hold one bucket and a share of its
    queries, cut by `at`.
    """
    parts = F.least(F.ceil(F.count(F.lit(1)) / most_rows), F.lit(512))
    fine = F.percentile_approx("value", F.array(*(F.lit(i / 512) for i in range(1, 512))), 10_000)
    cuts = points.groupBy(*by).agg(fine.alias("_q"), parts.alias("_p"))
    some = F.transform(F.sequence(F.lit(0), F.col("_p") - 1), lambda i: F.element_at(F.col("_q"), F.greatest(F.lit(1), F.floor(i * 512 / F.col("_p")).cast("int"))))
    cuts = cuts.select(*by, F.array_distinct(F.filter(F.slice(some, 2, 512), lambda c: c.isNotNull())).alias("_cuts"))

    def bucket(x: str) -> Column:
        return F.size(F.filter("_cuts", lambda c: c <= F.col(x)))

    held = points.join(cuts, list(by)).select(*by, bucket("value").alias("_b"), "value", "known")
    firsts = held.groupBy(*by, "_b").agg(F.min("known").alias("_first")).groupBy(*by).agg(F.collect_list(F.struct("_b", "_first")).alias("_firsts"))  # 512 at most
    asked = queries.select(*by, "x", "at").distinct().join(cuts, list(by)).join(firsts, list(by)).withColumn("_own", bucket("x"))
    later = F.array_min(F.transform(F.filter("_firsts", lambda f: (f["_b"] > F.col("_own")) & (f["_first"] <= F.col("at"))), lambda f: f["_b"]))
    part = F.floor(F.col("at") / (4 * most_rows)).alias("_part")
    asked = asked.select(*by, "x", "at", part, F.explode(F.array_compact(F.array("_own", later))).alias("_b"))
    wanted = asked.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_b").alias("_bb"), F.col("_part").alias("_pp")).distinct()
    same = [F.col(c) == F.col(f"_{c}") for c in by]
    held = held.join(wanted, [*same, F.col("_b") == F.col("_bb")]).select(*(f"_{c}" for c in by), "_bb", "_pp", "value", "known")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        value, known, x, at = (t.column(c).to_numpy() for t, c in ((right, "value"), (right, "known"), (left, "x"), (left, "at")))
        above = next_above(value, known, x, at) if len(value) else np.full(len(x), np.nan)
        has = np.flatnonzero(~np.isnan(above))
        return left.select([*by, "x", "at"]).take(pa.array(has)).append_column("above", pa.array(above[has]))

    schema = asked.select(*by, "x", "at", F.lit(None).cast("double").alias("above")).schema
    both = asked.groupBy(*by, "_b", "_part").cogroup(held.groupBy(*(f"_{c}" for c in by), "_bb", "_pp"))
    return both.applyInArrow(run, schema).groupBy(*by, "x", "at").agg(F.min("above").alias("above"))


def nearest_levels_history(bars: DataFrame, value: str = "close", by: str = "symbol", date: str = "date", lookback: int = 252,
                           edge: int = 5, most_rows: int = 100_000) -> DataFrame:
    """(by, date, current, nearest_resistance, nearest_support) of every row, from what was known then: as `nearest_levels` on the
    rows up to it. A swing point is known `edge` rows later; rows without a value are left out, without a level on one side
    the extreme of the last `lookback` rows stands in."""
    rows = swing_points(bars.filter(F.col(value).isNotNull()).select(by, date, F.col(value).cast("double").alias("current")), "current", edge=edge, by=by, date=date)
    w = ordered(by, date)
    rows = rows.withColumns({
        "_rn": F.row_number().over(w).cast("long"), "_hi": F.max("current").over(w.rowsBetween(1 - lookback, 0)), "_lo": F.min("current").over(w.rowsBetween(1 - lookback, 0))})
    # below is above with the sign turned
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), (s * F.col("current")).alias("x"), F.col(f).alias("swing")) for s, f in ((1, "swing_high"), (-1, "swing_low")))))
    both = rows.select(by, "_rn", sides.alias("_s")).select(by, "_s.*", "_rn")
    points = both.filter("swing").select(by, "side", F.col("x").alias("value"), (F.col("_rn") + edge).alias("known"))
    found = next_above_known(points, both.select(by, "side", "x", F.col("_rn").alias("at")), [by, "side"], most_rows)
    found = found.groupBy(by, F.col("at").alias("_rn")).agg(F.max(F.when(F.col("side") == 1, F.col("above"))).alias("_r"), F.max(F.when(F.col("side") == -1, -F.col("above"))).alias("_s"))
    out = rows.join(found, [by, "_rn"], "left")
    return out.select(by, date, "current", F.coalesce("_r", "_hi").alias("nearest_resistance"), F.coalesce("_s", "_lo").alias("nearest_support"))


def true_range(prev_close: str = "prev_close") -> Column:
    pc = F.col(prev_close)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Average true range; before n rows the mean absolute return times the price."""
    b = bars.withColumn("prev_close", lag("close"))
    b = b.withColumns({"_tr": true_range(), "_ar": F.abs(F.try_divide("close", "prev_close") - 1.0)})
    fallback = rolling(F.avg, "_ar", n, min_periods=1) * F.col("close")
    return b.withColumn("atr", F.coalesce(sma("_tr", n), fallback)).drop("_tr", "_ar", "prev_close")


def volatility(returns: DataFrame, ret: str = "ret") -> DataFrame:
    """Daily std over 20 rows, annual volatility over 20 and over 60 rows."""
    year = 252 ** 0.5
    return returns.withColumns({
        "daily_std": rolling_std(ret, 20), "annual_vol20": rolling_std(ret, 20) * year,
        "annual_vol60": rolling_std(ret, 60) * year})


def technical_levels(bars: DataFrame) -> DataFrame:
    """Latest moving averages and range extremes per symbol with the nearest levels."""
    cols = {f"ma{n}": sma("close", n) for n in (20, 60, 200)}
    for n in (20, 60, 252):
        cols[f"high_{n}"] = rolling(F.max, "close", n, min_periods=1)
        cols[f"low_{n}"] = rolling(F.min, "close", n, min_periods=1)
    names = list(cols)
    last = bars.withColumns(cols).groupBy("symbol").agg(
        F.max_by(F.struct(*names), "date").alias("_l")).select("symbol", "_l.*")
    return last.join(nearest_levels(bars), "symbol")


def technical_levels_history(bars: DataFrame) -> DataFrame:
    """Moving averages, range extremes and nearest levels of every row."""
    cols = {f"ma{n}": sma("close", n) for n in (20, 60, 200)}
    for n in (20, 60, 252):
        cols[f"high_{n}"] = rolling(F.max, "close", n, min_periods=1)
        cols[f"low_{n}"] = rolling(F.min, "close", n, min_periods=1)
    return bars.select("symbol", "date", *(c.alias(k) for k, c in cols.items())).join(nearest_levels_history(bars), ["symbol", "date"])


# Fixed values.
WIDTH = {"HIGH": 0.85, "MEDIUM": 1.00, "LOW": 1.20, "NONE": 1.40}


def _best(a: Column, b: Column, up: bool) -> Column:
    return F.greatest(a, b) if up else F.least(a, b)


def entry_target_stop(df: DataFrame) -> DataFrame:
    """Entry zone, target zone, stop and reward/risk of LONG and SHORT rows.

    Input columns: bias, confidence, current, atr, ma20, nearest_support, nearest_resistance and
    the 30-day analog quantiles median_return, p25_return, p75_return (percent).
    """
    c, a = F.col("current"), F.col("atr")
    wm = F.lit(1.0)
    for name, v in WIDTH.items():
        wm = F.when(F.col("confidence") == name, F.lit(v)).otherwise(wm)
    med = F.coalesce("median_return", F.lit(0.0))
    p25 = F.coalesce("p25_return", F.lit(-2.0))
    p75 = F.coalesce("p75_return", F.lit(2.0))
    sup, res, ma = F.col("nearest_support"), F.col("nearest_resistance"), F.col("ma20")
    long_ = F.col("bias") == "LONG"
    d = df.filter(F.col("bias").isin("LONG", "SHORT")).withColumn("_w", wm)
    w = F.col("_w")
    d = d.withColumns({
        "entry_low": F.when(long_, F.when(c < ma, c - a * w).otherwise(F.greatest(ma, sup) * w))
        .otherwise(c - a * 2 * w),
        "entry_high": F.when(long_, c + a * 2 * w).otherwise(F.least(ma, res) / w),
        "target_low": F.when(long_, c * (1 + F.greatest(med, F.lit(1.0)) / 100))
        .otherwise(F.greatest(c * (1 + F.least(p25, F.lit(-2.0)) / 100), sup * 0.98)),
        "target_high": F.when(long_, F.least(c * (1 + F.greatest(p75, F.lit(2.0)) / 100), res * 1.02))
        .otherwise(c * (1 + F.least(med, F.lit(-1.0)) / 100)),
    })
    mid = (F.col("entry_low") + F.col("entry_high")) / 2
    tmid = (F.col("target_low") + F.col("target_high")) / 2
    d = d.withColumn("stop_level", F.when(long_, F.greatest(mid - a * 3 * w, sup - a))
                     .otherwise(F.least(mid + a * 3 * w, res + a)))
    risk = F.abs(mid - F.col("stop_level"))
    reward = F.abs(tmid - mid)
    d = d.withColumn("rr_ratio", F.coalesce(F.round(F.try_divide(reward, risk), 1), F.lit(0.0)))
    names: Sequence[str] = ("entry_low", "entry_high", "target_low", "target_high", "stop_level")
    return d.withColumns({
        n: F.when(c > 1000, F.round(F.col(n), 0)).otherwise(F.round(F.col(n), 2)) for n in names
    }).drop("_w")
