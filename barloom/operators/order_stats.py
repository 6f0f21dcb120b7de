"""Exact ranks in long rolling frames, and the next value above among those known by a time.

A series is cut into chunks of equal row count, each with the rows of the frame before it. In a chunk the values become
ranks, and a wavelet matrix of them (one pass of bits per level, with running counts) tells for all rows at once how many of
the frame's values are smaller or equal: log2(chunk) vectorised steps, however long the frame. No frame is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.chunking import chunked


def counts_below(rank: np.ndarray, start: np.ndarray, stop: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many of rank[start:stop] are smaller than limit, for each query; ranks are whole numbers from 0."""
    below = np.zeros(len(limit), np.int64)
    bits = max(1, int(max(rank.max(initial=0), limit.max(initial=0))).bit_length())
    row, lo, hi = rank, start, stop
    for level in range(bits - 1, -1, -1):
        one = (row >> level) & 1
        zeros = np.concatenate(([0], np.cumsum(1 - one)))
        all_zeros = int(zeros[-1])
        lo0, hi0 = zeros[lo], zeros[hi]
        up = ((limit >> level) & 1).astype(bool)
        below += np.where(up, hi0 - lo0, 0)
        lo, hi = np.where(up, all_zeros + lo - lo0, lo0), np.where(up, all_zeros + hi - hi0, hi0)
        row = np.concatenate((row[one == 0], row[one == 1]))
    return below


def kth_smallest(rank: np.ndarray, start: np.ndarray, stop: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest (from 0) of rank[start:stop], for each query; k < stop - start."""
    out = np.zeros(len(k), np.int64)
    row, lo, hi, k = rank, start, stop, k.copy()
    for level in range(max(1, int(rank.max(initial=0)).bit_length()) - 1, -1, -1):
        one = (row >> level) & 1
        zeros = np.concatenate(([0], np.cumsum(1 - one)))
        lo0, hi0 = zeros[lo], zeros[hi]
        up = k >= hi0 - lo0
        k -= np.where(up, hi0 - lo0, 0)
        out |= up.astype(np.int64) << level
        lo, hi = np.where(up, int(zeros[-1]) + lo - lo0, lo0), np.where(up, int(zeros[-1]) + hi - hi0, hi0)
        row = np.concatenate((row[one == 0], row[one == 1]))
    return out


def next_above(value: np.ndarray, known: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The smallest value above x among those known up to `at`, for each query; NaN if there is none."""
    order = np.argsort(known, kind="stable")
    values, rank = np.unique(value[order], return_inverse=True)
    stop = np.searchsorted(known[order], at, side="right")
    start = np.zeros(len(x), np.int64)
    below = counts_below(rank, start, stop, np.searchsorted(values, x, side="right"))
    out = np.full(len(x), np.nan)
    has = np.flatnonzero(below < stop)
    out[has] = values[kth_smallest(rank, start[has], stop[has], below[has])]
    return out


def frame_places(x: np.ndarray, known: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(smaller, equal, known) values in the n rows that end with each row; unknown ones do not count."""
    rank = np.empty(len(x), np.int64)
    values, rank[known] = np.unique(x[known], return_inverse=True)
    rank[~known] = len(values)  # above all
    stop = np.arange(1, len(x) + 1)
    start = np.maximum(stop - n, 0)
    seen = np.concatenate(([0], np.cumsum(known)))
    less = counts_below(rank, start, stop, rank)
    upto = counts_below(rank, start, stop, rank + 1)
    return less, upto - less, seen[stop] - seen[start]


def rolling_places(df: DataFrame, x: str, n: int, keys: Sequence[str], order: Sequence[str], bucket: Column, chunk_rows: int = 250_000) -> DataFrame:
    """`df` with less, same and known: how many of the last n values (the own one included) are smaller than, equal to and not
    missing beside x. Of a row with a missing x, less and same are missing. `bucket` as in `number_rows`; the order is
    total. Further columns pass through unread."""
    carry = chunked(df, n - 1, keys, order, bucket, chunk_rows).withColumn("_row", F.struct(*df.columns))
    schema = carry.select("_row", *(F.lit(None).cast("long").alias(c) for c in ("less", "same", "known"))).schema

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_rn")
        value = table.column("_x")
        known = ~np.asarray(value.is_null().to_numpy())
        less, same, seen = frame_places(value.fill_null(0.0).to_numpy(), known, n)
        own = np.flatnonzero(~table.column("_halo").to_numpy())
        hide = pa.array(~known[own])
        out = {c: pa.array(v[own], mask=hide.to_numpy(zero_copy_only=False)) for c, v in (("less", less), ("same", same))}
        return pa.table({"_row": table.column("_row").take(pa.array(own)), **out, "known": seen[own]})

    part = carry.select(F.struct(*keys, "_chunk").alias("_k"), "_rn", "_halo", F.col(x).cast("double").alias("_x"), F.when(~F.col("_halo"), F.col("_row")).alias("_row"))
    made = part.groupBy("_k").applyInArrow(lambda t: run(t.drop_columns(["_k"])), schema)
    return made.select("_row.*", "less", "same", "known")


def rank_pct_long(df: DataFrame, x: str, n: int, keys: Sequence[str], order: Sequence[str], bucket: Column, min_periods: int | None = None,
                  chunk_rows: int = 250_000) -> DataFrame:
    """`df` with rank_pct (average-tie percentile rank of x in the last n values, `min_periods` of them known), pct_lt and
    pct_le (shares smaller and up to x); the values of `rank_pct_rolling`, `pct_lt_tail` and `pct_le_tail`."""
    d = rolling_places(df, x, n, keys, order, bucket, chunk_rows)
    less, same, known = F.col("less"), F.col("same"), F.col("known")
    return d.withColumns({
        "rank_pct": F.when(known >= (n if min_periods is None else min_periods), (less + (same + 1) / 2.0) / known),
        "pct_lt": F.try_divide(less, known), "pct_le": F.try_divide(less + same, known)}).drop("less", "same", "known")
