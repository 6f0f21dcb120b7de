"""Exponentially weighted means (WN-12)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.rolling import over


def block_rows(alpha: float) -> int:
    """Rows after which the weight (1-alpha)^n is below double precision."""
    return math.ceil(-16.0 * math.log(10.0) / math.log(1.0 - alpha))


def with_ewm(df: DataFrame, cols: Mapping[str, str], alpha: float, adjust: bool = False, min_periods: int = 1,
             by: Sequence[str] = ("symbol",), order: Sequence[str] = ("date",)) -> DataFrame:
    """Add exponentially weighted means; `cols` maps output to input column.

    The recursion y = (1-alpha)*y + alpha*x is a weighted running sum. Rows are cut into blocks so
    long that what lies before the preceding block has no weight at double precision; the mean is
    the running sum inside the block plus the decayed total of the block before. Each step is a
    running window: linear in the rows, without collected frames. Missing inputs are skipped.
    """
    q, size = 1.0 - alpha, block_rows(alpha)
    out = df
    running = " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    for name, src in cols.items():
        weight = "1.0D" if adjust else f"CASE WHEN _ew_c = 1 THEN 1.0D ELSE {alpha!r}D END"
        value = "_ew_l + _ew_p"
        if adjust:
            value = f"({value}) / ((1.0D - pow({q!r}D, _ew_c)) / {alpha!r}D)"
        d = out.withColumn("_ew_c", F.expr(f"count(`{src}`) {over(by, order, running)}"))
        d = d.withColumns({
            "_ew_o": F.expr(f"greatest(_ew_c - 1, 0) % {size}"), "_ew_b": F.expr(f"(_ew_c - 1) div {size}")})
        inside = over((*by, "_ew_b"), order, running)
        d = d.withColumn("_ew_l", F.expr(
            f"coalesce(sum(`{src}` * {weight} * pow({q!r}D, -_ew_o)) {inside}, 0.0D) * pow({q!r}D, _ew_o)"))
        before = over(by, ("_ew_b",), " RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING")
        closing = f"CASE WHEN `{src}` IS NOT NULL AND _ew_o = {size - 1} THEN _ew_l END"
        d = d.withColumn("_ew_p", F.expr(f"coalesce(sum({closing}) {before}, 0.0D) * pow({q!r}D, _ew_o + 1)"))
        d = d.withColumn(name, F.expr(f"CASE WHEN _ew_c >= {max(min_periods, 1)} THEN {value} END"))
        out = d.drop("_ew_c", "_ew_o", "_ew_b", "_ew_l", "_ew_p")
    return out
