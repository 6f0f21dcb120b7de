"""Historical analogs: state features, similar dates, what followed (AN)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rolling import diff, pct_change, rank_pct_full, rank_pct_rolling, sma
from barloom.operators.align import nearest_asof, nth_bar_after
from barloom.session import stored

NOKEY = {"by": ()}
FEATURES = (
    "vix_pct", "vix_chg20", "spread", "spread_chg20",
    "gold_mom20", "gold_mom60", "sp_mom20", "sp_mom60", "nifty_mom20", "nifty_mom60", "crude_mom20", "crude_mom60",
    "sp_vs_ma200",
)


def state_features(panel: DataFrame, cols: Mapping[str, str], history: int | None = None) -> DataFrame:
    """Thirteen features per date from an aligned panel; `cols` names vix, spread, gold, sp, nifty, crude.

    The volatility rank is over the full sample (for the newest date), or over the last `history` rows (for every date).
    """
    c = cols
    rank = rank_pct_full(c["vix"], by=()) if history is None else rank_pct_rolling(c["vix"], history, by=())
    feats = {
        "vix_pct": rank, "vix_chg20": pct_change(c["vix"], 20, **NOKEY),
        "spread": F.col(c["spread"]), "spread_chg20": diff(c["spread"], 20, **NOKEY),
        "sp_vs_ma200": F.col(c["sp"]) / sma(c["sp"], 200, **NOKEY) - 1,
    }
    for name in ("gold", "sp", "nifty", "crude"):
        for k in (20, 60):
            feats[f"{name}_mom{k}"] = pct_change(c[name], k, **NOKEY)
    return panel.select("date", *[feats[f].alias(f) for f in FEATURES]).na.drop()


def similar_states(features: DataFrame, k: int = 5, min_similarity: float = 0.70, gap_days: int = 90,
                   min_history: int = 100, names: Sequence[str] = FEATURES) -> DataFrame:
    """Top-k past dates by cosine similarity to the latest state.

    Features are standardised on the history older than the gap. Target and statistics are one row
    each and enter as scalar subqueries; the history is a plain scan with a distributed top-k.
    """
    last = features.agg(F.max("date")).scalar()
    target = features.agg(F.max_by(F.struct(*names), "date")).scalar()
    history = features.filter(F.col("date") < F.date_sub(last, gap_days))
    stats = history.agg(F.struct(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f).alias(f"m_{f}") for f in names], *[F.stddev_pop(f).alias(f"s_{f}") for f in names])).scalar()
    h = history.withColumns({"_t": target, "_s": stats})
    dot = na = nb = F.lit(0.0)
    for f in names:
        std = F.when(F.col(f"_s.s_{f}") == 0, 1.0).otherwise(F.col(f"_s.s_{f}"))
        a, b = (F.col(f) - F.col(f"_s.m_{f}")) / std, (F.col(f"_t.{f}") - F.col(f"_s.m_{f}")) / std
        dot, na, nb = dot + a * b, na + a * a, nb + b * b
    scored = h.filter(F.col("_s.n") >= min_history).select(
        F.col("date").alias("analog_date"), F.try_divide(dot, F.sqrt(na * nb)).alias("similarity"))
    top = scored.orderBy(F.col("similarity").desc(), "analog_date").limit(k)
    return top.filter(F.col("similarity") >= min_similarity)


def _vectors(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.stack([table.column(f).to_numpy() for f in names], axis=1)


def _days(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int32()).to_numpy().astype(np.int64)


def analog_history(features: DataFrame, k: int = 5, min_similarity: float = 0.70, gap_days: int = 90, min_history: int = 100,
                   names: Sequence[str] = FEATURES, width: int = 512) -> DataFrame:
    """(date, analog_date, similarity, place): for every date its k most similar dates more than `gap_days` older.

    As `similar_states` for each date with the history known then: features are standardised on the candidates' mean and
    population deviation, ties go to the earlier date, dates with fewer than `min_history` candidates have no analogs.
    `features` is unique by date, without missing values, and is read three times: pass a stored table.

    Dates are cut into blocks of `width` days. A block gives its sums and the range of every feature (its box); that table
    has a row per block, 70 for a century, and goes to all tasks. Then:

    1. A date adds the sums of the blocks before its cut-off to those of the cut-off's own block up to it. It wants a block
       of candidates only if the block's box can hold a vector of `min_similarity` under the date's standardisation: the
       largest product with a vector of the box against the smallest norm of one.
    2. Pairs of blocks that are still wanted are the tasks; each gives at most k candidates for each of its dates.

    No task holds more than two blocks, whatever the length of the history.
    """
    n = len(names)
    rows = features.select("date", F.floor(F.unix_date("date") / width).cast("int").alias("b"), *names)

    def sums(table: pa.Table) -> pa.Table:
        x = _vectors(table, names)
        out = {"b": table.column("b").slice(0, 1), "n": [len(x)]}
        return pa.table(out | {c: [v] for c, v in (("total", x.sum(0)), ("squares", (x * x).sum(0)), ("lo", x.min(0)), ("hi", x.max(0)))})

    schema = "b int, n long, total array<double>, squares array<double>, lo array<double>, hi array<double>"
    blocks = sorted(rows.groupBy("b").applyInArrow(sums, schema).collect())  # a row per block of days
    number = np.array([r.b for r in blocks])
    lo, hi = (np.array([r[c] for r in blocks]).reshape(-1, n) for c in ("lo", "hi"))
    zero = np.zeros((1, n))
    count, total, squares = (np.cumsum(np.concatenate((z, np.array([r[c] for r in blocks], float).reshape(-1, *z.shape[1:]))), axis=0) for c, z in (("n", np.zeros(1)), ("total", zero), ("squares", zero)))

    def standardised(left: pa.Table, right: pa.Table) -> pa.Table:
        """Dates whose cut-off lies in a block (left) with the rows of that block (right)."""
        x, date = _vectors(left, names), _days(left.column("date"))
        right = right.sort_by("date")
        y, seen = _vectors(right, names), np.searchsorted(_days(right.column("date")), date - gap_days)
        before = np.searchsorted(number, left.column("cut")[0].as_py()) if len(x) else 0
        add = lambda v: np.concatenate((zero, np.cumsum(v, axis=0)))[seen]
        m = count[before] + seen
        keep = m >= max(1, min_history)
        x, date, m = x[keep], date[keep], m[keep, None]
        mean = (total[before] + add(y)[keep]) / m
        spread = np.sqrt(np.maximum((squares[before] + add(y * y)[keep]) / m - mean * mean, 0.0))
        spread[spread == 0] = 1.0
        z = (x - mean) / spread
        row, block = [], []
        own = (z * z).sum(1)
        for i in range(before + 1 if before < len(number) else before):
            low, high = (lo[i] - mean) / spread, (hi[i] - mean) / spread
            near = np.maximum(np.maximum(low, -high), 0.0)
            reach = np.maximum(z * low, z * high).sum(1) >= min_similarity * np.sqrt(own * (near * near).sum(1)) - 1e-9
            found = np.flatnonzero(reach | (min_similarity <= 0))
            row.append(found)
            block.append(np.full(len(found), number[i], np.int32))
        row = np.concatenate([np.empty(0, np.int64), *row])
        days = pa.array(date[row].astype(np.int32)).cast(pa.date32())
        lists = {c: pa.FixedSizeListArray.from_arrays(pa.array(v[row].ravel()), n).cast(pa.list_(pa.float64())) for c, v in (("z", z), ("mean", mean), ("spread", spread))}
        return pa.table({"c": np.concatenate([np.empty(0, np.int32), *block]), "t": (date[row] // width).astype(np.int32), "date": days, **lists})

    cut = rows.withColumn("cut", F.floor((F.unix_date("date") - gap_days - 1) / width).cast("int"))
    wanted = cut.groupBy("cut").cogroup(rows.groupBy("b")).applyInArrow(standardised, "c int, t int, date date, z array<double>, mean array<double>, spread array<double>")
    wanted = stored(wanted, "wanted")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("analog_date")
        date, old, x = _days(left.column("date")), _days(right.column("analog_date")), _vectors(right, names)
        z, mean, spread = (left.column(c).combine_chunks().flatten().to_numpy().reshape(-1, n) for c in ("z", "mean", "spread"))
        dot, other = np.zeros((len(date), len(old))), np.zeros((len(date), len(old)))
        for f in range(n):
            y = (x[None, :, f] - mean[:, None, f]) / spread[:, None, f]
            dot, other = dot + z[:, None, f] * y, other + y * y
        norm = np.sqrt((z * z).sum(1)[:, None] * other)
        score = np.where((norm > 0) & (old[None, :] < date[:, None] - gap_days), dot / np.where(norm > 0, norm, 1.0), -np.inf)
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        row, column = np.repeat(np.arange(len(date)), top.shape[1]), top.ravel()
        keep = score[row, column] >= min_similarity
        row, column = row[keep], column[keep]
        return pa.table({"date": left.column("date").take(pa.array(row)), "analog_date": right.column("analog_date").take(pa.array(column)), "similarity": score[row, column]})

    pairs = wanted.select(F.col("c").alias("b"), F.col("t").alias("u")).distinct()
    held = rows.withColumnRenamed("date", "analog_date").join(pairs, "b")
    each = wanted.groupBy("c", "t").cogroup(held.groupBy("b", "u")).applyInArrow(best, "date date, analog_date date, similarity double")
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("similarity"), "analog_date"))  # k per pair of blocks
    return each.withColumn("place", place).filter(F.col("place") <= k)


def analog_outcomes(analogs: DataFrame, bars: DataFrame, symbols: Sequence[str],
                    horizons: Sequence[int] = (10, 30, 60)) -> DataFrame:
    """Forward return of each symbol after each analog date, snapped to its nearest bar."""
    each = F.array(*[F.lit(s) for s in symbols])
    events = analogs.select(F.explode(each).alias("symbol"), F.col("analog_date").alias("date"), "similarity")
    base = nearest_asof(events, bars.select("symbol", "date", "close"), ["close"])
    base = base.select("symbol", F.col("date").alias("analog_date"), F.col("matched_date").alias("date"),
                       "similarity", F.col("close").alias("base_price"))
    out = nth_bar_after(base, bars.select("symbol", "date", "close"), list(horizons))
    ret = (F.col("price_after") / F.col("base_price") - 1) * 100.0
    return out.filter(F.col("price_after").isNotNull()).select(
        "symbol", "analog_date", "similarity", "horizon", ret.alias("forward_return"))


def history_outcomes(analogs: DataFrame, bars: DataFrame, symbols: Sequence[str], horizons: Sequence[int] = (10, 30, 60)) -> DataFrame:
    """(date, symbol, analog_date, horizon, forward_return) of `analog_history`: what followed each analog, as far as known
    on the date. A past date is followed up once, however many dates it is an analog of."""
    w = Window.partitionBy("symbol").orderBy("date")
    ahead = {f"_f{h}": F.struct(((F.lead("close", h).over(w) / F.col("close") - 1) * 100.0).alias("ret"), F.lead("date", h).over(w).alias("known")) for h in horizons}
    ahead = bars.select("symbol", "date", *(c.alias(name) for name, c in ahead.items()))
    each = F.explode(F.array(*[F.lit(s) for s in symbols])).alias("symbol")
    events = analogs.select(F.col("analog_date").alias("date")).distinct().select(each, "date", F.lit(0).alias("_x"))
    base = nearest_asof(events, ahead, list(ahead.columns[2:]))
    after = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"_f{h}").alias("o")) for h in horizons))).alias("_a")
    after = base.select("symbol", F.col("date").alias("analog_date"), after).select("symbol", "analog_date", "_a.horizon", "_a.o.ret", "_a.o.known")
    both = analogs.select("date", "analog_date").join(after, "analog_date").filter(F.col("known") <= F.col("date"))
    return both.select("date", "symbol", "analog_date", "horizon", F.col("ret").alias("forward_return"))


def outcome_summary(outcomes: DataFrame, by: Sequence[str] = ("symbol", "horizon")) -> DataFrame:
    """Median, mean, quantiles and clipped share of positive outcomes (percent)."""
    q = F.percentile("forward_return", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))
    g = outcomes.groupBy(*by).agg(
        q.alias("_q"), F.avg("forward_return").alias("mean_return"), F.count(F.lit(1)).alias("n_analogs"),
        F.avg(F.when(F.col("forward_return") > 0, 1.0).otherwise(0.0)).alias("_p"))
    names = ("p10_return", "p25_return", "median_return", "p75_return", "p90_return")
    prob = F.greatest(F.lit(0.30), F.least(F.lit(0.80), F.col("_p"))) * 100.0
    return g.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)], "mean_return",
                    prob.alias("prob_positive"), "n_analogs")
