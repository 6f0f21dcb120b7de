"""Change detection over history (CH)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.rolling import lag


def label_changes(df: DataFrame, label: str, by: Sequence[str] = ("symbol",), date: str = "date") -> DataFrame:
    """Rows whose label differs from the previous row's."""
    d = df.withColumn("prev_label", lag(label, by=by, order=date))
    return d.filter(F.col("prev_label").isNotNull() & (F.col("prev_label") != F.col(label)))


def threshold_cross(df: DataFrame, value: str, rules: Sequence[tuple[str, str, float]], by: Sequence[str] = (),
                    date: str = "date") -> DataFrame:
    """First matching crossing per row; rules are (alert, 'up'|'down'|'up_to'|'below', level).

    up: prev <= level < now; down: prev >= level > now; up_to: prev < level <= now.
    """
    d = df.withColumn("prev", lag(value, by=by, order=date))
    now, prev = F.col(value), F.col("prev")
    out = F.lit(None).cast("string")
    for name, way, level in reversed(rules):
        hit = {
            "up": (now > level) & (prev <= level), "down": (now < level) & (prev >= level),
            "up_to": (now >= level) & (prev < level),
        }[way]
        out = F.when(hit, name).otherwise(out)
    return d.withColumn("alert", out).filter(F.col("alert").isNotNull())


# Alert levels.
VIX_RULES = [("CRISIS", "up", 30.0), ("CAUTION", "up", 20.0), ("CALM", "down", 20.0)]
SENTIMENT_RULES = [("EXTREME_NEGATIVE", "down", -0.50), ("EXTREME_POSITIVE", "up", 0.50)]
CURVE_RULES = [("INVERTED", "down", 0.0), ("NORMALISED", "up_to", 0.0)]


def daily_snapshot(df: DataFrame, names: Mapping[str, str], values: Sequence[str], key: str = "symbol",
                   date: str = "date") -> DataFrame:
    """Latest values of every listed series as one row."""
    picks = []
    for sym, name in names.items():
        on = F.when(F.col(key) == sym, F.col(date))
        picks.append(F.max(on).alias(f"{name}_date"))
        picks += [F.max_by(v, on).alias(f"{name}_{v}") for v in values]
    return df.agg(*picks)
