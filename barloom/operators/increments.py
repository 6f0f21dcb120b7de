"""Daily runs that carry their window state on, so a day costs a day (SK-2).

The state holds, per key, the last `lookback` rows with the running values up to them, under the newest date merged. A run
puts the new rows behind the state, computes, writes the new dates and then the next state. Results are written per date
and the state last, in one commit each: a run that dies in between is repeated from the old state and writes the same rows
again. States are versions, so the newest days can be run again with corrected rows as long as an older state is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.session import stored
from barloom.sources import versions

#: Running aggregates whose value goes on from the value before, and the step that does so.
_CARRIED: dict[str, tuple[Callable, Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "product": (F.product, lambda a, b: a * b),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def _state_before(spark: SparkSession, path: str, day: str) -> versions.Version | None:
    """The newest state of an earlier date than `day`."""
    kept = versions.versions(spark, path)
    for number in reversed(kept):
        found = versions.version(spark, path, number)
        if max(found.folders) < day:
            return found
    if kept:
        raise ValueError(f"no state before {day} is kept in {path}: run from an earlier date into a new folder")
    return None


def run_increment(rows: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], lookback: int,
                  running: Mapping[str, tuple[str, Column]] | None = None, by: Sequence[str] = ("symbol",), date: str = "date",
                  partition: str | None = None, keep: int = 3) -> str | None:
    """Compute the dates of `rows` behind the stored state and merge them; the newest date merged.

    rows: all rows of one or more dates, newer than those merged (or equal to the newest ones, to run them again: then all
    dates from there on are given). (by, date) is a key; rows without a date take no part. compute adds columns of
    which a row's depend on its own and the `lookback` rows before it. running: column -> ("sum" | "product" | "max" |
    "min", expression over the computed columns), over all rows of the key so far, missing ones skipped. A key that has no
    new row keeps its state. partition: a column of `rows` made from the date (month, year) by which results are stored where
    dates are small; a run then rewrites the partitions it touches. No rows change nothing (None). Results: `read_results`; the state has keys x lookback rows.
    """
    spark, running = rows.sparkSession, dict(running or {})
    rows = rows.filter(F.col(date).isNotNull())
    ends = rows.agg(F.min(date).cast("string"), F.max(date).cast("string")).first()
    if ends[0] is None:
        return None
    old = _state_before(spark, f"{path}/state", ends[0])
    now = versions.version(spark, f"{path}/state")
    source = rows.columns
    names = [f"_run_{c}" for c in running]
    both = rows.withColumn("_new", F.lit(True))
    if old:
        state = versions.read_version(spark, f"{path}/state", old.number)
        both = both.withColumns({n: F.lit(None).cast(state.schema[n].dataType) for n in names})
        both = state.select(*source, F.lit(False).alias("_new"), *names).unionByName(both)
    done = compute(both)
    w = Window.partitionBy(*by).orderBy(date)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the state and the new rows
    for out, (kind, value) in running.items():
        total, step = _CARRIED[kind]
        fresh = total(F.when(F.col("_new"), value)).over(so_far)
        if old:
            before = F.last(F.when(~F.col("_new"), F.col(f"_run_{out}")), ignorenulls=True).over(so_far)
            fresh = F.when(fresh.isNull() | before.isNull(), F.coalesce(fresh, before)).otherwise(step(before, fresh))
            fresh = F.when(F.col("_new"), fresh).otherwise(F.col(f"_run_{out}"))
        done = done.withColumn(f"_at_{out}", fresh)
    done = stored(done.drop(*names).withColumnsRenamed({f"_at_{c}": f"_run_{c}" for c in running}), "increment")  # read three times
    results = done.filter("_new").drop("_new").withColumnsRenamed({f"_run_{c}": c for c in running})
    if partition:
        versions.commit_upsert(results, f"{path}/results", [*by, date, partition], partition)
    else:
        versions.commit_run_date(results, f"{path}/results", date)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(date)))
    last = done.withColumn("_place", place).filter(F.col("_place") <= lookback)
    last = last.select(*source, *names, F.lit(ends[1]).alias("_as_of"))
    versions.commit_replace(last, f"{path}/state", "_as_of", now)
    versions.expire(spark, f"{path}/state", keep)
    return ends[1]


def read_results(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """All dates merged so far."""
    return versions.read_version(spark, f"{path}/results", number)
