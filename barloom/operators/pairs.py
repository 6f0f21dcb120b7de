"""Pairs of tracked series from the wide panel.

The panel holds a fixed list of series, so pairs are read off its columns: no self join, and the
rows per date are exactly the tracked pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_rows(wide: DataFrame, pairs: Sequence[tuple[str, str]], labels: Mapping[str, str] | None = None,
              date: str = "date") -> DataFrame:
    """(date, a, b, x, y) for every tracked pair with both values present."""
    name = labels or {}
    cells = [
        F.struct(
            F.lit(name.get(a, a)).alias("a"), F.lit(name.get(b, b)).alias("b"),
            F.col(a).alias("x"), F.col(b).alias("y"),
        )
        for a, b in pairs
    ]
    long = wide.select(date, F.explode(F.array(*cells)).alias("_p")).select(date, "_p.*")
    return long.na.drop(subset=["x", "y"])


def _corr(x: str, y: str):
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_samp(px, py), F.stddev_samp(px) * F.stddev_samp(py))


def corr_matrix(wide: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of each tracked pair in one aggregation pass -> (a, b, corr)."""
    sums = wide.groupBy(*by).agg(*[_corr(a, b).alias(f"c_{a}_{b}") for a, b in pairs])
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c_{a}_{b}").alias("corr"))
        for a, b in pairs
    ]
    return sums.select(*by, F.explode(F.array(*cells)).alias("_p")).select(*by, "_p.*")
