"""Correlations of all pairs of many series, from the long table (AG-3, RK-2, RK-3).

Members are dealt into blocks, dates into ranges. A task holds two blocks of members over one range of dates and takes the
partial outer products of values and presence; the parts of a pair add up over the ranges. No pair is listed, no wide panel
is built, and a task's memory depends on `block` and `days` alone. A row is sent once per block, so the shuffle is rows x
blocks; the result has a row per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import stored

_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _matrix(rows: pa.Table, names: pa.Array, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (missing: 0) and presence by date and member; rows of one cell are averaged."""
    cell = at * len(names) + pc.index_in(rows.column("m"), names).to_numpy()
    count = np.bincount(cell, minlength=width * len(names)).reshape(width, len(names))
    total = np.bincount(cell, rows.column("z").to_numpy(), minlength=width * len(names)).reshape(width, len(names))
    return total / np.maximum(count, 1), (count > 0).astype(float)


def _partial(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.combine_chunks()
    i, j = (k.as_py() for k in key[:2])
    days, at = np.unique(rows.column("d").to_numpy(), return_inverse=True)
    sides = []
    for g in (i, j):
        mask = pc.equal(rows.column("g"), g)
        part = rows.filter(mask)
        names = pc.unique(part.column("m")).sort() if part.num_rows else pa.array([], pa.string())
        sides.append((names, *_matrix(part, names, at[mask.to_numpy()], len(days))))
    (a, x, mx), (b, y, my) = sides
    sums = dict(n=mx.T @ my, sx=x.T @ my, sy=mx.T @ y, sxx=(x * x).T @ my, syy=mx.T @ (y * y), sxy=x.T @ y)
    keep = sums["n"] > 0
    if i == j:
        keep &= np.triu(np.ones_like(keep), 1)
    u, v = np.nonzero(keep)
    columns = {"a": a.take(pa.array(u)), "b": b.take(pa.array(v))} | {k: sums[k][u, v] for k in _SUMS}
    return pa.table(columns, pa.schema([("a", pa.string()), ("b", pa.string()), *((k, pa.float64()) for k in _SUMS)]))


def block_corr(series: DataFrame, member: str = "symbol", date: str = "date", value: str = "ret", block: int = 256, days: int = 4096) -> DataFrame:
    """(a, b, n, corr) with a < b: Pearson over the dates on which both members have a value, for pairs that share a date.

    `member` is a string. Rows without member, date or value (null, NaN) take no part, repeated rows of a member and date
    are averaged. corr is missing for fewer than two dates or where a side is constant on the shared ones.
    """
    rows = series.select(F.col(member).alias("m"), F.datediff(date, F.lit("1970-01-01")).alias("d"), F.col(value).cast("double").alias("x"))
    rows = rows.filter("m IS NOT NULL AND d IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)")
    stats = stored(rows.groupBy("m").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")), "members")
    n = max(1, -(-stats.count() // block))
    flat = F.col("sd") <= 1e-12 * F.abs("mean")
    scale = stats.select("m", "mean", F.when(flat | (F.col("sd") == 0), None).otherwise(F.col("sd")).alias("sd"))
    z = F.coalesce((F.col("x") - F.col("mean")) / F.col("sd"), F.lit(0.0))
    rows = rows.join(scale, "m").select("m", "d", z.alias("z"), F.pmod(F.xxhash64("m"), F.lit(n)).cast("int").alias("g"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = rows.select("m", "d", "z", "g", F.least("g", "k").alias("i"), F.greatest("g", "k").alias("j"), F.floor(F.col("d") / days).alias("r"))
    parts = rows.groupBy("i", "j", "r").applyInArrow(_partial, "a string, b string, " + ", ".join(f"{k} double" for k in _SUMS))
    swap = F.col("a") > F.col("b")
    parts = parts.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n", "sxy",
        *[F.when(swap, F.col(o)).otherwise(F.col(k)).alias(k) for k, o in (("sx", "sy"), ("sy", "sx"), ("sxx", "syy"), ("syy", "sxx"))])
    s = parts.groupBy("a", "b").agg(*[F.sum(k).alias(k) for k in _SUMS])

    def spread(one: str, square: str):
        left = F.col(square) - F.col(one) * F.col(one) / F.col("n")
        return F.when(left > 1e-12 * F.col(square), left)

    corr = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(spread("sx", "sxx") * spread("sy", "syy"))
    return s.select("a", "b", F.col("n").cast("long").alias("n"), F.when(F.col("n") > 1, corr).alias("corr"))
