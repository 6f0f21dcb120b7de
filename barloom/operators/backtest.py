"""Backtests, validation, tracking and re-aimed forecasts (BT)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import (
    cumulative, forward_return, frame, lag, lead, ordered, pct_change, rolling_corr, row_no, sma, whole,
)
from barloom.functions.scalar import ladder, map_label
from barloom.operators.align import asof_join, nth_bar_after

YEAR = math.sqrt(252)


def positions(score: str | Column, cut: float = 0.15, short_mode: str = "cash") -> Column:
    """1 at or above the threshold; at or below its negative cash (0) or -1."""
    s = F.col(score) if isinstance(score, str) else score
    low = -1.0 if short_mode == "short" else 0.0
    return F.when(s >= cut, 1.0).when(s <= -cut, low).otherwise(0.0)


def strategy_returns(df: DataFrame, score: str = "score", cost: float = 0.001, cut: float = 0.15,
                     by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Add position, ret (0 on the first row), strat_ret (missing on the first row)."""
    k = {"by": by}
    d = df.withColumn("position", positions(score, cut))
    d = d.withColumns({
        "ret": F.coalesce(pct_change("close", **k), F.lit(0.0)),
        "_prev": lag("position", **k),
    })
    moved = F.abs(F.col("position") - F.col("_prev"))
    d = d.withColumn("trade", F.coalesce(moved > 0, F.lit(False)))
    return d.withColumn("strat_ret", F.col("_prev") * F.col("ret") - moved * cost).drop("_prev")


def perf_metrics(df: DataFrame, ret: str = "strat_ret", by: Sequence[str] = ("symbol",), date: str = "date",
                 prefix: str = "") -> DataFrame:
    """Return, risk and ratio metrics of a return column per group; missing returns are skipped.

    One window for the running equity, then one aggregation.
    """
    r = F.col(ret)
    w = cumulative(by, date)
    d = df.withColumn("_e", 100.0 * F.product(1.0 + F.coalesce(r, F.lit(0.0))).over(w))
    d = d.withColumn("_dd", F.col("_e") / F.max("_e").over(w) - 1.0)
    std, mean = F.stddev_samp(r), F.avg(r)
    down = F.stddev_samp(F.when(r < 0, r))
    g = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.max_by("_e", date).alias("_last"), F.min("_dd").alias("_mdd"),
        (mean / (std + 1e-10) * YEAR).alias("sharpe"),
        (mean / (down + 1e-10) * YEAR).alias("sortino"),
        (std * YEAR * 100.0).alias("volatility"),
        (F.try_divide(F.count_if(r > 0), F.count_if(r != 0)) * 100.0).alias("win_rate"),
    )
    cagr = F.pow(F.col("_last") / 100.0, 252.0 / F.col("_n")) - 1.0
    out = g.withColumns({
        "total_return": (F.col("_last") / 100.0 - 1.0) * 100.0, "cagr": cagr * 100.0,
        "max_dd": F.col("_mdd") * 100.0, "calmar": cagr / F.abs(F.col("_mdd") + 1e-10),
    }).drop("_n", "_last", "_mdd")
    names = ("total_return", "cagr", "sharpe", "sortino", "calmar", "max_dd", "volatility", "win_rate")
    return out.select(*by, *[F.col(c).alias(prefix + c) for c in names])


def trade_stats(df: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if("trade").alias("trades"), (F.avg("position") * 100.0).alias("exposure"))


def portfolio_equal_weight(df: DataFrame, cols: Sequence[str], members: int, date: str = "date",
                           by: Sequence[str] = ()) -> DataFrame:
    """Mean across members on the dates on which all of them have every column."""
    ok = df.na.drop(subset=list(cols))
    g = ok.groupBy(*by, date).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in cols])
    return g.filter(F.col("_n") == members).drop("_n")


def yearly_holdout(df: DataFrame, train_years: int = 3, min_rows: int = 20, cost: float = 0.001) -> DataFrame:
    """Metrics per symbol and test year. Scores are not refitted: each year is a plain hold-out."""
    y = F.year("date")
    d = df.withColumns({"year": y})
    d = d.withColumns({"_first": F.min("year").over(whole()), "_last": F.max("year").over(whole())})
    d = d.filter((F.col("year") >= F.col("_first") + train_years) & (F.col("year") < F.col("_last")))
    by = ("symbol", "year")
    d = d.withColumn("_rows", F.count(F.lit(1)).over(whole(by))).filter(F.col("_rows") >= min_rows)
    r = strategy_returns(d.select("symbol", "year", "date", "close", "score"), cost=cost, by=by)
    strat = perf_metrics(r, "strat_ret", by)
    bench = perf_metrics(r, "ret", by, prefix="bnh_")
    return strat.join(bench, list(by))


def yearly_portfolio(df: DataFrame, members: int, train_years: int = 3, min_rows: int = 20,
                     cost: float = 0.001) -> DataFrame:
    """Equal-weight portfolio per test year with the beat flag."""
    d = df.withColumn("year", F.year("date"))
    first, last = d.agg(F.min("year")).scalar(), d.agg(F.max("year")).scalar()
    d = d.filter((F.col("year") >= first + train_years) & (F.col("year") < last))
    by = ("symbol", "year")
    r = strategy_returns(d.select("symbol", "year", "date", "close", "score"), cost=cost, by=by)
    p = portfolio_equal_weight(r, ["strat_ret", "ret"], members, by=("year",))
    p = p.withColumn("_n", F.count(F.lit(1)).over(whole("year"))).filter(F.col("_n") >= min_rows)
    s = perf_metrics(p, "strat_ret", ("year",)).select("year", "cagr", "sharpe", "max_dd")
    b = perf_metrics(p, "ret", ("year",), prefix="bnh_").select("year", "bnh_cagr", "bnh_sharpe")
    return s.join(b, "year").withColumn("beat_bnh", F.col("sharpe") > F.col("bnh_sharpe"))


def signal_forward_stats(df: DataFrame, k: int = 20, label: str = "signal") -> DataFrame:
    """Forward return per symbol: mean, count and std for Long and Short, edge and market mean."""
    f = df.withColumn("_f", forward_return("close", k))
    long_, short = (F.when(F.col(label) == s, F.col("_f")) for s in ("Long", "Short"))
    g = f.groupBy("symbol").agg(
        F.avg(long_).alias("long_mean"), F.count(long_).alias("long_n"), F.stddev_samp(long_).alias("long_std"),
        F.avg(short).alias("short_mean"), F.count(short).alias("short_n"), F.avg("_f").alias("market_mean"))
    return g.withColumn("edge", F.col("long_mean") - F.col("short_mean"))


def friction_backtest(df: DataFrame, cost_bps: Sequence[float], base_bps: float = 10.0, min_rows: int = 60) -> DataFrame:
    """Annual Sharpe of ±1 positions under several trade costs, trades per year, extra drag."""
    pos = map_label("signal", {"Long": 1.0, "Short": -1.0}, 0.0)
    d = df.withColumns({"_p": pos, "_r": pct_change("close")})
    d = d.withColumns({"_prev": lag("_p")})
    d = d.withColumns({
        "_t": F.when(F.abs(F.col("_p") - F.col("_prev")) > 0.5, 1.0).otherwise(0.0),
        "_g": F.col("_prev") * F.col("_r"),
    })
    cells = F.array(*[F.lit(float(b)) for b in cost_bps])
    s = d.withColumn("cost_bps", F.explode(cells))
    net = F.col("_g") - F.col("_t") * F.col("cost_bps") / 10_000.0
    g = s.groupBy("symbol", "cost_bps").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(net).alias("_m"), F.stddev_samp(net).alias("_s"),
        F.sum("_t").alias("_trades"), F.datediff(F.max("date"), F.min("date")).alias("_days"))
    ok = (F.col("_n") >= min_rows) & (F.col("_s") >= 1e-8)
    per_year = F.col("_trades") / F.greatest(F.col("_days") / 365.25, F.lit(1.0))
    return g.select(
        "symbol", "cost_bps", F.when(ok, F.col("_m") / F.col("_s") * YEAR).alias("sharpe"),
        per_year.alias("trades_pa"), (per_year * (F.col("cost_bps") - base_bps)).alias("extra_drag_bps"))


def component_stats(df: DataFrame, score: str = "score", n: int = 60, need: int = 30,
                    by: Sequence[str] = ("symbol",)) -> DataFrame:
    """IC, hit rate and sign-strategy Sharpe of a score against the next return, over n rows."""
    d = df.withColumn("_r", forward_return("close", 1, by=by)).na.drop(subset=["_r", score])
    s, r, w = F.col(score), F.col("_r"), frame(n, by)
    d = d.withColumns({"_h": F.when((s > 0) == (r > 0), 1.0).otherwise(0.0), "_g": r * F.signum(s)})
    enough = F.count(F.lit(1)).over(w) >= need
    sharpe = F.try_divide(F.avg("_g").over(w), F.stddev_samp("_g").over(w)) * YEAR
    return d.withColumns({
        "ic": rolling_corr(score, "_r", n, min_periods=need, by=by),
        "hit_rate": F.when(enough, F.avg("_h").over(w)),
        "sharpe": F.when(enough, sharpe),
    }).drop("_r", "_h", "_g")


# Base weights and adjustment limits.
BASE_WEIGHTS = {"signal": 0.35, "analog": 0.25, "sentiment": 0.15, "macro": 0.15, "yield": 0.05, "vix": 0.05}
IC_HIGH, IC_LOW, MAX_ADJ, MIN_FLOOR = 0.10, -0.05, 0.07, 0.02


def adaptive_weights(ic: DataFrame, base: Mapping[str, float] = BASE_WEIGHTS) -> DataFrame:
    """Adjust the base weight of each component by its IC, floor and renormalise per symbol and date."""
    d = ic.withColumn("base", map_label("component", base))
    step = F.least(F.col("base") * 0.20, F.lit(MAX_ADJ))
    raw = F.when(F.col("ic") > IC_HIGH, F.col("base") + step).when(F.col("ic") < IC_LOW, F.col("base") - step)
    d = d.withColumn("_raw", F.greatest(F.coalesce(raw, F.col("base")), F.lit(MIN_FLOOR)))
    total = F.sum("_raw").over(Window.partitionBy("symbol", "date"))
    return d.withColumn("weight", F.round(F.col("_raw") / total, 6)).drop("_raw")


def weight_changes(weights: DataFrame, cut: float = 0.10) -> DataFrame:
    """Rebalances whose weight moved by more than `cut` relative to the previous one."""
    w = ordered(("symbol", "component"))
    old = F.coalesce(F.lag("weight").over(w), F.col("base"))
    d = weights.withColumn("old_weight", old)
    moved = F.abs(F.col("weight") - F.col("old_weight"))
    return d.filter((moved > 1e-6) & (moved / F.greatest(F.col("old_weight"), F.lit(1e-9)) > cut))


def record_signals(decisions: DataFrame, log: DataFrame, prices: DataFrame) -> DataFrame:
    """Decisions not yet in the log, with the first price on or after their date."""
    new = decisions.join(log.select("symbol", "date"), ["symbol", "date"], "left_anti")
    px = prices.select("symbol", "date", F.col("close").alias("price_at_signal"))
    return asof_join(new, px, ["price_at_signal"], direction="forward").withColumn("status", F.lit("OPEN"))


def signal_outcomes(log: DataFrame, prices: DataFrame, horizons: Sequence[int] = (10, 30, 60),
                    as_of: Column | None = None) -> DataFrame:
    """One row per signal and horizon that is due: return, target and stop flags, label."""
    o = nth_bar_after(log, prices.select("symbol", "date", "close"), list(horizons), out="price_at_outcome")
    due = F.date_add(F.col("date"), F.ceil(F.col("horizon") * 1.4).cast("int")) <= (as_of if as_of is not None else F.current_date())
    o = o.filter(due & F.col("price_at_outcome").isNotNull() & F.col("price_at_signal").isNotNull())
    long_ = F.col("bias") == "LONG"
    px = F.col("price_at_outcome")
    ret = (px - F.col("price_at_signal")) / F.col("price_at_signal") * 100.0
    target = F.when(long_, px >= F.col("target_high")).otherwise(px <= F.col("target_low"))
    stop = F.when(long_, px <= F.col("stop_level")).otherwise(px >= F.col("stop_level"))
    o = o.withColumns({
        "return_pct": F.round(F.when(long_, ret).otherwise(-ret), 2),
        "hit_target": F.coalesce(target, F.lit(False)), "hit_stop": F.coalesce(stop, F.lit(False)),
    })
    label = (
        F.when(F.col("hit_target"), "TARGET HIT").when(F.col("hit_stop"), "STOP HIT")
        .when(F.col("return_pct") > 2, "WINNING").when(F.col("return_pct") < -2, "LOSING").otherwise("FLAT")
    )
    return o.withColumn("outcome_label", label)


def close_finished(log: DataFrame, outcomes: DataFrame, horizons: int = 3) -> DataFrame:
    """Status CLOSED for signals with an outcome at every horizon."""
    done = outcomes.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("_n"))
    j = log.join(done, ["symbol", "date"], "left")
    return j.withColumn("status", F.when(F.col("_n") >= horizons, "CLOSED").otherwise("OPEN")).drop("_n")


def outcome_hit_rate(outcomes: DataFrame, ends: DataFrame, days: int = 60, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """(by, hit_rate): share of tracked outcomes with a gain, of the signals of the last `days` days before `_end`."""
    j = outcomes.select(*by, "date", "return_pct").join(ends.select(*by, "_end"), list(by))
    recent = j.filter(F.col("date") >= F.date_sub("_end", days))
    return recent.groupBy(*by).agg(F.avg((F.col("return_pct") > 0).cast("double")).alias("hit_rate"))


def model_health(df: DataFrame, days: int = 135, by: Sequence[str] = ("symbol",), outcomes: DataFrame | None = None) -> DataFrame:
    """Recent Sharpe, drawdowns and hit rate -> status and alert list.

    `df` holds symbol, date, close and score; the window is the last `days` calendar days. The hit rate is that of the
    tracked `outcomes` (missing where there are none), or without them the newest of the column hit_rate.
    """
    if outcomes is not None:
        ends = df.groupBy(*by).agg(F.max("date").alias("_end"))
        df = df.drop("hit_rate").join(outcome_hit_rate(outcomes, ends, by=by), list(by), "left")
    d = df.withColumn("_end", F.max("date").over(whole(by)))
    d = d.filter(F.col("date") >= F.date_sub("_end", days))
    r = strategy_returns(d, by=by)
    w = cumulative(by)
    r = r.withColumn("_e", 100.0 * F.product(1.0 + F.coalesce("strat_ret", F.lit(0.0))).over(w))
    r = r.withColumn("_dd", (F.col("_e") / F.max("_e").over(w) - 1.0) * 100.0)
    std = F.stddev_samp("strat_ret")
    g = r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("strat_ret").alias("_m"), std.alias("_s"),
        F.min("_dd").alias("_mdd"), F.max_by("_dd", "date").alias("_cdd"), F.max_by("hit_rate", "date").alias("_h"))
    sharpe = F.when(F.col("_s") == 0, 0.0).otherwise(F.col("_m") / F.col("_s") * YEAR)
    g = g.withColumns({
        "sharpe": F.when(F.col("_n") >= 20, F.round(sharpe, 3)), "max_dd": F.round("_mdd", 2),
        "current_dd": F.round("_cdd", 2), "hit_rate": F.round(F.col("_h") * 100.0, 1)})
    critical = (F.col("sharpe") < 0.0), (F.col("hit_rate") < 35.0), (F.col("current_dd") < -25.0)
    warning = (F.col("sharpe") < 0.20), (F.col("hit_rate") < 45.0), (F.col("current_dd") < -15.0)

    def any_of(conds) -> Column:
        out = F.lit(False)
        for c in conds:
            out = out | F.coalesce(c, F.lit(False))
        return out

    names = ("sharpe", "hit rate", "drawdown")
    alerts = F.array_compact(F.array(*[
        F.when(c, F.lit(f"{n} critical")).when(wn, F.lit(f"{n} warning"))
        for n, c, wn in zip(names, critical, warning)
    ]))
    status = F.when(any_of(critical), "CRITICAL").when(any_of(warning), "WARNING").otherwise("HEALTHY")
    return g.withColumns({"status": status, "alerts": alerts}).select(
        *by, "sharpe", "max_dd", "current_dd", "hit_rate", "status", "alerts")


def portfolio_health(df: DataFrame, days: int = 135, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row: Sharpe, drawdowns and status of the equal-weight mean of all strategies.

    Days on which every symbol has a strategy return count; the window is the last `days` days of each symbol.
    """
    d = df.withColumn("_end", F.max("date").over(whole(by))).filter(F.col("date") >= F.date_sub("_end", days))
    r = strategy_returns(d, by=by).select(*by, "date", "strat_ret")
    n = r.select(*by).distinct().agg(F.count("*").alias("_all"))
    daily = r.groupBy("date").agg(F.avg("strat_ret").alias("strat_ret"), F.count("strat_ret").alias("_have"))
    daily = daily.join(n, F.col("_have") == F.col("_all")).select("date", "strat_ret")
    w = cumulative((), "date")  # one row per date
    e = daily.withColumn("_e", F.product(1.0 + F.col("strat_ret")).over(w))
    e = e.withColumn("_dd", (F.col("_e") / F.max("_e").over(w) - 1.0) * 100.0)
    std = F.stddev_samp("strat_ret")
    sharpe = F.when(std == 0, 0.0).otherwise(F.avg("strat_ret") / std * YEAR)
    g = e.agg(F.when(F.count("*") >= 20, F.round(sharpe, 3)).alias("sharpe"), F.round(F.min("_dd"), 2).alias("max_dd"),
              F.round(F.max_by("_dd", "date"), 2).alias("current_dd"))
    bad = F.coalesce(F.col("sharpe") < 0.0, F.lit(False)) | F.coalesce(F.col("current_dd") < -25.0, F.lit(False))
    weak = F.coalesce(F.col("sharpe") < 0.20, F.lit(False)) | F.coalesce(F.col("current_dd") < -15.0, F.lit(False))
    return g.withColumn("status", F.when(bad, "CRITICAL").when(weak, "WARNING").otherwise("HEALTHY"))


# ------------------------------------------------------------------------- re-aimed forecasts


def ar_fit(df: DataFrame, n: int = 504, ret: str = "ret", by: Sequence[str] = ("symbol",)) -> DataFrame:
    """AR(1) slope and intercept by least squares over the last n returns."""
    d = df.withColumn("_x", lag(ret, by=by))
    w = frame(n, by)
    full = F.count("_x").over(w) >= n
    return d.withColumns({
        "ar_b": F.when(full, F.regr_slope(F.col(ret), F.col("_x")).over(w)),
        "ar_a": F.when(full, F.regr_intercept(F.col(ret), F.col("_x")).over(w)),
    }).drop("_x")


def ar_sum(h: int, ret: str = "ret") -> Column:
    """Sum of the next h predicted returns in closed form."""
    b, a, r = F.col("ar_b"), F.col("ar_a"), F.col(ret)
    m = F.try_divide(a, 1.0 - b)
    return h * m + (r - m) * b * F.try_divide(1.0 - F.pow(b, F.lit(float(h))), 1.0 - b)


def ar_fit_p(df: DataFrame, p: int, n: int = 504, ret: str = "ret", by: Sequence[str] = ("symbol",)) -> DataFrame:
    """AR(p) by least squares over the last n returns: intercept ar_a and slopes ar_b (an array, lag 1 first).

    The covariances of the lags are window aggregates over one frame; the p normal equations are solved by elimination on
    an array of rows. Missing before n full rows and where the lags are linearly dependent.
    """
    names = [f"_x{k}" for k in range(p + 1)]
    d = df.withColumns({name: F.col(ret) if k == 0 else lag(ret, k, by=by) for k, name in enumerate(names)})
    whole = F.col(names[0])
    for name in names[1:]:
        whole = F.when(F.col(name).isNotNull(), whole)
    d = d.withColumns({name: F.when(whole.isNotNull(), F.col(name)) for name in reversed(names)})
    w = frame(n, by)
    full = F.count("_x0").over(w) >= n
    cov = {f"_c{i}_{j}": F.covar_pop(names[i], names[j]).over(w) for i in range(p + 1) for j in range(max(i, 1), p + 1)}
    d = d.withColumns(cov | {f"_m{k}": F.avg(name).over(w) for k, name in enumerate(names)} | {"_full": full})

    def c(i: int, j: int) -> Column:
        return F.col(f"_c{min(i, j)}_{max(i, j)}")

    rows = F.array(*(F.array(*(c(i, j) for j in range(1, p + 1)), c(0, i)) for i in range(1, p + 1)))

    def eliminate(m: Column, k: Column) -> Column:
        pivot = F.transform(m[k], lambda x: F.try_divide(x, m[k][k]))
        return F.transform(m, lambda row, i: F.when(i == k, pivot).otherwise(F.zip_with(row, pivot, lambda x, y: x - row[k] * y)))

    d = d.withColumn("ar_b", F.when(F.col("_full"), F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), rows, eliminate), lambda row: row[p])))
    d = d.withColumn("ar_b", F.when(~F.exists("ar_b", lambda x: x.isNull() | F.isnan(x)), F.col("ar_b")))
    means = F.array(*(F.col(f"_m{k}") for k in range(1, p + 1)))
    fitted = F.aggregate(F.zip_with("ar_b", means, lambda x, m: x * m), F.lit(0.0), lambda s, x: s + x)
    return d.withColumn("ar_a", F.col("_m0") - fitted).drop(*names, *cov, *(f"_m{k}" for k in range(p + 1)), "_full")


def ar_forecast(df: DataFrame, h: int = 30, n: int = 504, p: int = 1, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """h-step price forecast of an AR(p) model: predicted returns compounded on the last price."""
    if p == 1:
        f = ar_fit(df, n, by=by)
        slopes, last = F.array("ar_b"), F.array("ret")
    else:
        f = ar_fit_p(df, p, n, by=by).withColumn("_last", F.array("ret", *(lag("ret", k, by=by) for k in range(1, p))))
        slopes, last = F.col("ar_b"), F.col("_last")

    def step(s: Column, _: Column) -> Column:
        r = F.aggregate(F.zip_with(slopes, s.last, lambda b, x: b * x), F.col("ar_a"), lambda a, x: a + x)
        moved = F.transform(F.array(r), lambda x: F.struct(F.slice(F.concat(F.array(x), s.last), 1, p).alias("last"), (s.price * (1.0 + x)).alias("price")))
        return moved[0]

    start = F.struct(last.alias("last"), F.lit(1.0).alias("price"))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(h)), start, step, lambda s: s.price)
    d = f.withColumn("forecast", F.col("close") * path).drop("_last")
    pct = (F.col("forecast") - F.col("close")) / F.col("close") * 100.0
    way = F.when(F.col("forecast").isNull(), F.lit(None)).when(F.col("forecast") > F.col("close"), "UP").otherwise("DOWN")
    return d.withColumns({"forecast_pct": pct, "direction": way})


def directional_accuracy(df: DataFrame, n: int = 252, step: int = 21, window: int = 12) -> DataFrame:
    """Every `step` rows: predicted against realised sign of the next `step` returns."""
    f = ar_fit(df, n).withColumns({"rn": row_no()})
    ahead = ordered().rowsBetween(1, step)
    f = f.withColumns({
        "_act": F.when(F.count("ret").over(ahead) == step, F.sum("ret").over(ahead)), "_pred": ar_sum(step)})
    t = f.filter(F.col("ar_b").isNotNull() & F.col("_act").isNotNull())
    t = t.withColumn("_k", F.row_number().over(ordered())).filter((F.col("_k") - 1) % step == 0)
    t = t.withColumn("correct", F.when((F.col("_pred") > 0) == (F.col("_act") > 0), 1.0).otherwise(0.0))
    return t.withColumn("accuracy", sma("correct", window) * 100.0).drop("_k", "_act", "_pred")


def df_tstat(df: DataFrame, x: str = "close", by: Sequence[str] = ("symbol",)) -> DataFrame:
    """t-statistic of the change of x on its lagged level (stationarity test without lags)."""
    d = df.withColumn("_l", lag(x, by=by)).withColumn("_d", F.col(x) - F.col("_l")).na.drop(subset=["_d"])
    y, l = F.col("_d"), F.col("_l")
    g = d.groupBy(*by).agg(
        F.regr_slope(y, l).alias("slope"), F.regr_sxx(y, l).alias("_sxx"), F.regr_syy(y, l).alias("_syy"),
        F.regr_sxy(y, l).alias("_sxy"), F.count(F.lit(1)).alias("n"))
    s2 = (F.col("_syy") - F.col("slope") * F.col("_sxy")) / (F.col("n") - 2)
    return g.withColumn("tstat", F.try_divide("slope", F.sqrt(s2 / F.col("_sxx")))).drop("_sxx", "_syy", "_sxy")


def forecast_consensus(first: str, second: str) -> Column:
    a, b = F.col(first), F.col(second)
    return F.when(a.isNull() | b.isNull(), "N/A").when((a > 0) == (b > 0), "AGREE").otherwise("SPLIT")
