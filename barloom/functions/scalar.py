"""Row-level column builders: clips, ladders, lookups, safe arithmetic."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def name(x: object) -> str | None:
    """Quoted column name, or None for anything that is not a plain name.

    Builders write a plain name as one SQL expression: the same plan, but one call into the JVM
    instead of one per operator, which matters for operators with many steps.
    """
    if isinstance(x, str) and x.isidentifier():
        return f"`{x}`"
    return None


def literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{v!r}D" if isinstance(v, float) else str(v)


def clip(x: str | Column, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; a missing value stays missing (greatest/least would skip it)."""
    if q := name(x):
        lo, hi = literal(float(lo)), literal(float(hi))
        return F.expr(f"CASE WHEN {q} < {lo} THEN {lo} WHEN {q} > {hi} THEN {hi} ELSE {q} END")
    x = col(x)
    return F.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)


def linear_score(x: str | Column, scale: float, centre: float = 0.0) -> Column:
    """Map linearly around `centre` and clip to [-1, 1]; negative `scale` inverts."""
    return clip((col(x) - centre) / scale, -1.0, 1.0)


def ladder(
    x: str | Column,
    steps: Iterable[tuple[str, float, object]],
    default: object,
    on_null: object = None,
) -> Column:
    """Ordered thresholds -> value; the first matching step wins."""
    if q := name(x):
        when = " ".join(f"WHEN {q} {op} {literal(cut)} THEN {literal(value)}" for op, cut, value in steps)
        return F.expr(f"CASE WHEN {q} IS NULL THEN {literal(on_null)} {when} ELSE {literal(default)} END")
    x = col(x)
    out = F.when(x.isNull(), F.lit(on_null))
    for op, cut, value in steps:
        out = out.when(_COMPARE[op](x, F.lit(cut)), F.lit(value))
    return out.otherwise(F.lit(default))


def map_label(x: str | Column, mapping: Mapping[str, object], default: object = None) -> Column:
    """Small dictionary lookup, folded to a literal CASE so it stays inside codegen."""
    if q := name(x):
        when = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in mapping.items())
        return F.expr(f"CASE {q} {when} ELSE {literal(default)} END")
    x = col(x)
    items = iter(mapping.items())
    key, value = next(items)
    out = F.when(x == key, F.lit(value))
    for key, value in items:
        out = out.when(x == key, F.lit(value))
    return out.otherwise(F.lit(default))


def prefix_code(x: str | Column) -> Column:
    """Leading upper-case code of a `CODE (explanation)` text."""
    return F.regexp_extract(col(x), r"^\s*([A-Z][A-Z0-9_]*)", 1)


def ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


def change_vs_previous(x: str | Column, prev: str | Column) -> Column:
    """(x - prev) / |prev| * 100; 0 where the previous value is 0."""
    x, prev = col(x), col(prev)
    return F.when(prev == 0, F.lit(0.0)).otherwise((x - prev) / F.abs(prev) * 100.0)


def no_nan(x: str | Column) -> Column:
    """NaN -> null. Spark orders NaN above all numbers, so it must not enter an operator."""
    x = col(x)
    return F.when(~F.isnan(x), x)


def weighted_sum(weights: Mapping[str, float]) -> Column:
    out = None
    for name, w in weights.items():
        term = F.col(name) * F.lit(float(w))
        out = term if out is None else out + term
    return out
