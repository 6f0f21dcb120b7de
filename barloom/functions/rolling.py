"""Window column builders over an ordered series.

All builders default to one series per `symbol`, ordered by `date`. A daily series holds at most
one row per calendar day (`(symbol, date)` is a key of the bar table), so the largest window
partition is bounded by the calendar and not by the size of the raw data. Series without such a
bound (ticks) go through `operators.chunking`, which adds a chunk column to `by`.

Chains of builders with the same `by`/`order` share one exchange and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.scalar import clip, col, name

Keys = str | Sequence[str]
BY, ORDER = ("symbol",), ("date",)
TRADING_DAYS = 252


def _names(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def ordered(by: Keys = BY, order: Keys = ORDER) -> WindowSpec:
    return Window.partitionBy(*_names(by)).orderBy(*_names(order))


def frame(n: int, by: Keys = BY, order: Keys = ORDER, skip: int = 0) -> WindowSpec:
    """The n rows ending `skip` rows before the current one."""
    return ordered(by, order).rowsBetween(-(n - 1) - skip, -skip)


def over(by: Keys, order: Keys, rows: str = "") -> str:
    """OVER clause of an ordered series, for builders that write one SQL expression."""
    part = ", ".join(f"`{k}`" for k in _names(by))
    keys = ", ".join(f"`{k}`" for k in _names(order))
    return f"OVER ({f'PARTITION BY {part} ' if part else ''}ORDER BY {keys}{rows})"


def over_frame(n: int, by: Keys, order: Keys, skip: int = 0) -> str:
    end = f"{skip} PRECEDING" if skip else "CURRENT ROW"
    return over(by, order, f" ROWS BETWEEN {n - 1 + skip} PRECEDING AND {end}")


def cumulative(by: Keys = BY, order: Keys = ORDER) -> WindowSpec:
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole(by: Keys = BY) -> WindowSpec:
    return Window.partitionBy(*_names(by))


def full(x: str | Column, n: int, value: Column, w: WindowSpec, min_periods: int | None = None) -> Column:
    """`value` once the frame holds `min_periods` (default n) values of x."""
    return F.when(F.count(col(x)).over(w) >= (n if min_periods is None else min_periods), value)


def rolling(
    agg: Callable[..., Column],
    x: str | Column,
    n: int,
    min_periods: int | None = None,
    skip: int = 0,
    by: Keys = BY,
    order: Keys = ORDER,
) -> Column:
    """Aggregate over n rows, missing until `min_periods` (default n) values are present."""
    if q := name(x):
        o, need = over_frame(n, by, order, skip), n if min_periods is None else min_periods
        return F.expr(f"CASE WHEN count({q}) {o} >= {need} THEN {agg.__name__}({q}) {o} END")
    w = frame(n, by, order, skip)
    return full(x, n, agg(col(x)).over(w), w, min_periods)


def sma(x, n, **kw) -> Column:
    return rolling(F.avg, x, n, **kw)


def rolling_std(x, n, **kw) -> Column:
    return rolling(F.stddev_samp, x, n, **kw)


def rolling_min(x, n, **kw) -> Column:
    return rolling(F.min, x, n, **kw)


def rolling_max(x, n, **kw) -> Column:
    return rolling(F.max, x, n, **kw)


def realised_vol(ret, n, **kw) -> Column:
    return rolling_std(ret, n, **kw) * math.sqrt(TRADING_DAYS) * 100.0


def lag(x, k=1, by: Keys = BY, order: Keys = ORDER) -> Column:
    if q := name(x):
        return F.expr(f"lag({q}, {k}) {over(by, order)}")
    return F.lag(col(x), k).over(ordered(by, order))


def lead(x, k=1, by: Keys = BY, order: Keys = ORDER) -> Column:
    if q := name(x):
        return F.expr(f"lead({q}, {k}) {over(by, order)}")
    return F.lead(col(x), k).over(ordered(by, order))


def pct_change(x, k=1, by: Keys = BY, order: Keys = ORDER) -> Column:
    if q := name(x):
        return F.expr(f"try_divide({q}, lag({q}, {k}) {over(by, order)}) - 1.0D")
    return F.try_divide(col(x), lag(x, k, by, order)) - 1.0


def diff(x, k=1, by: Keys = BY, order: Keys = ORDER) -> Column:
    if q := name(x):
        return F.expr(f"{q} - lag({q}, {k}) {over(by, order)}")
    return col(x) - lag(x, k, by, order)


def forward_return(x, k=1, **kw) -> Column:
    return F.try_divide(lead(x, k, **kw), col(x)) - 1.0


def range_position(x, n, min_periods=None, by: Keys = BY, order: Keys = ORDER) -> Column:
    """0-100 position of x inside its n-row range; missing on a flat range."""
    w = frame(n, by, order)
    lo, hi = F.min(col(x)).over(w), F.max(col(x)).over(w)
    return full(x, n, F.try_divide(col(x) - lo, hi - lo) * 100.0, w, min_periods)


def normalise_pm1(x, n=252, min_periods=60, by: Keys = BY, order: Keys = ORDER) -> Column:
    """Range position scaled to [-1, 1]; x lies inside its own range, so no clip is needed."""
    w = frame(n, by, order)
    lo, hi = F.min(col(x)).over(w), F.max(col(x)).over(w)
    return full(x, n, (col(x) - lo) / (hi - lo + 1e-10) * 2.0 - 1.0, w, min_periods)


def zscore(x, n, limit: float | None = None, by: Keys = BY, order: Keys = ORDER) -> Column:
    w = frame(n, by, order)
    z = F.try_divide(col(x) - F.avg(col(x)).over(w), F.stddev_samp(col(x)).over(w))
    z = full(x, n, z, w)
    return z if limit is None else _limit(z, limit)


def _limit(z: Column, limit: float) -> Column:
    """Clip with a single evaluation of z; a missing z stays missing."""
    return F.transform(F.array(z), lambda v: clip(v, -limit, limit))[0]


def rolling_corr(x, y, n, min_periods=None, by: Keys = BY, order: Keys = ORDER) -> Column:
    """Pearson correlation over n rows; missing when either side is constant."""
    both = col(x).isNotNull() & col(y).isNotNull()
    px, py = F.when(both, col(x)), F.when(both, col(y))
    w = frame(n, by, order)
    need = n if min_periods is None else min_periods
    sd = F.stddev_samp(px).over(w) * F.stddev_samp(py).over(w)
    return F.when(F.count(px).over(w) >= need, F.try_divide(F.covar_samp(px, py).over(w), sd))


def rolling_beta(y, x, n, by: Keys = BY, order: Keys = ORDER) -> Column:
    """Slope of y on x over n rows."""
    both = col(x).isNotNull() & col(y).isNotNull()
    px, py = F.when(both, col(x)), F.when(both, col(y))
    w = frame(n, by, order)
    return F.when(
        F.count(px).over(w) >= n,
        F.try_divide(F.covar_samp(py, px).over(w), F.var_samp(px).over(w)),
    )


def rolling_r2(y, x, n, **kw) -> Column:
    """R² of y on x with intercept: the squared correlation."""
    c = rolling_corr(y, x, n, **kw)
    return c * c


def compounded(ret, n, by: Keys = BY, order: Keys = ORDER) -> Column:
    w = frame(n, by, order)
    return F.when(F.count(col(ret)).over(w) >= n, F.product(1.0 + col(ret)).over(w) - 1.0)


def _history(x, n, by, order) -> Column:
    return F.collect_list(col(x)).over(frame(n, by, order))


def _place(x, n, by: Keys, order: Keys, finish) -> Column:
    """Count values below, equal to, and in the frame of x, in one pass over the frame."""
    x = col(x)
    zero = F.struct(F.lit(0).alias("less"), F.lit(0).alias("same"), F.lit(0).alias("n"))
    return F.aggregate(
        _history(x, n, by, order), zero,
        lambda a, v: F.struct(
            (a.less + (v < x).cast("int")).alias("less"), (a.same + (v == x).cast("int")).alias("same"),
            (a.n + 1).alias("n")),
        finish,
    )


def rank_pct_rolling(x, n, min_periods=None, by: Keys = BY, order: Keys = ORDER) -> Column:
    """Average-tie percentile rank (0-1) of x among its last n values."""
    need = n if min_periods is None else min_periods
    rank = _place(x, n, by, order, lambda a: F.when(a.n >= need, (a.less + (a.same + 1) / 2.0) / a.n))
    return F.when(col(x).isNotNull(), rank)


def pct_lt_tail(x, n, by: Keys = BY, order: Keys = ORDER) -> Column:
    """Share of the last n values strictly below x."""
    return F.when(col(x).isNotNull(), _place(x, n, by, order, lambda a: F.try_divide(a.less, a.n)))


def rank_pct_full(x, by: Keys = BY) -> Column:
    """Average-tie percentile rank over the full sample."""
    w = Window.partitionBy(*_names(by)).orderBy(col(x))
    ties = F.count(col(x)).over(Window.partitionBy(*_names(by), col(x)))
    return F.when(
        col(x).isNotNull(),
        (F.sum(F.when(col(x).isNotNull(), 1)).over(w) - (ties - 1) / 2.0)
        / F.count(col(x)).over(whole(by)),
    )


def pct_le_tail(x, n, by: Keys = BY, order: Keys = ORDER) -> Column:
    """Share of the last n values (the own one included) that is <= x; nothing looks ahead."""
    return F.when(col(x).isNotNull(), _place(x, n, by, order, lambda a: F.try_divide(a.less + a.same, a.n)))


def pct_le_full(x, by: Keys = BY) -> Column:
    """Share of the full sample that is <= x."""
    return F.cume_dist().over(Window.partitionBy(*_names(by)).orderBy(col(x)))


def drawdown(equity, by: Keys = BY, order: Keys = ORDER) -> Column:
    peak = F.max(col(equity)).over(cumulative(by, order))
    return F.try_divide(col(equity), peak) - 1.0


def equity_curve(ret, start=100.0, by: Keys = BY, order: Keys = ORDER) -> Column:
    """start * prod(1 + r); a missing return counts as no change."""
    return F.lit(float(start)) * F.product(1.0 + F.coalesce(col(ret), F.lit(0.0))).over(
        cumulative(by, order)
    )


def rolling_sharpe(ret, n, by: Keys = BY, order: Keys = ORDER) -> Column:
    w = frame(n, by, order)
    sharpe = F.avg(col(ret)).over(w) / (F.stddev_samp(col(ret)).over(w) + 1e-10) * math.sqrt(TRADING_DAYS)
    return full(ret, n, sharpe, w)


def block_mean_change(x, a, b, by: Keys = BY, order: Keys = ORDER) -> Column:
    """Mean of the last a rows minus mean of the b rows before them."""
    return sma(x, a, by=by, order=order) - sma(x, b, skip=a, by=by, order=order)


def trend_slope(x, n, rn="rn", by: Keys = BY, order: Keys = ORDER) -> Column:
    """Least-squares slope of x on the row number over n rows."""
    w = frame(n, by, order)
    return F.when(F.count(col(x)).over(w) >= n, F.regr_slope(col(x), F.col(rn).cast("double")).over(w))


def carried(x, by: Keys = BY, order: Keys = ORDER) -> Column:
    """Last non-missing value up to the current row."""
    if q := name(x):
        rows = " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        return F.expr(f"last({q}) IGNORE NULLS {over(by, order, rows)}")
    return F.last(col(x), ignorenulls=True).over(cumulative(by, order))


def carried_back(x, by: Keys = BY, order: Keys = ORDER) -> Column:
    """Next non-missing value from the current row on (looks ahead).

    Runs over the descending order: a frame that is open towards the end of the partition is
    evaluated anew for every row, a running one is not.
    """
    down = [F.col(k).desc() for k in _names(order)]
    w = Window.partitionBy(*_names(by)).orderBy(*down).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(col(x), ignorenulls=True).over(w)


def row_no(by: Keys = BY, order: Keys = ORDER) -> Column:
    return F.row_number().over(ordered(by, order))
