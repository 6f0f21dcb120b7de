"""Daily runs with carried state against one run over everything, with failures and repeats in between."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions.rolling import lag, sma
from barloom.operators import increments as I
from barloom.session import work_dir
from barloom.sources import versions

DAY = datetime.date(2024, 1, 1)
SCHEMA = "symbol string, date date, close double"


def series(n):
    r = random.Random(2)
    keys = {"a": 0, "b": 0, "late": n - 5, "gone": 0}
    return [(k, DAY + datetime.timedelta(i), float(r.randrange(50, 90))) for i in range(n) for k, start in keys.items()
            if i >= start and (k != "gone" or i < 6) and (k != "b" or i % 3)]


def compute(d):
    d = d.withColumns({"mean": sma("close", 4), "before": lag("close")})
    return d.withColumn("moved", F.col("close") - F.col("before"))


def content(df):
    return {(r.symbol, r.date): tuple(round(r[c], 9) if r[c] is not None else None for c in ("close", "mean", "moved", "total", "low", "growth")) for r in df.collect()}


def run(spark, path, rows, partition=None):
    grow = {"total": ("sum", F.col("moved")), "low": ("min", F.col("close")), "growth": ("product", 1 + F.coalesce("moved", F.lit(0.0)) / 100)}
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1).withColumn("month", F.month("date"))
    return I.run_increment(df, path, compute, 4, grow, partition=partition)


def days(rows, first, last=None):
    return [x for x in rows if (x[1] - DAY).days in range(first, (last or first) + 1)]


@pytest.mark.parametrize(("partition", "n", "steps"), [(None, 38, 30), ("month", 34, 5)])
def test_single_days_equal_one_run(spark, monkeypatch, partition, n, steps):
    rows = series(n)
    whole, step = work_dir(spark, "whole"), work_dir(spark, "step")
    assert run(spark, whole, rows, partition) == str(DAY + datetime.timedelta(n - 1))
    want = content(I.read_results(spark, whole))
    assert len(want) == len(rows)
    run(spark, step, days(rows, 0, n - steps - 1), partition)
    for i in range(n - steps, n):
        if i == n - 4:  # dies between the results and the state
            with monkeypatch.context() as m:
                m.setattr(versions, "commit_replace", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
                with pytest.raises(RuntimeError):
                    run(spark, step, days(rows, i), partition)
        if i == n - 2:  # a day with wrong rows, run again below
            run(spark, step, [(k, d, c + 7) for k, d, c in days(rows, i)], partition)
        run(spark, step, days(rows, i), partition)
    assert content(I.read_results(spark, step)) == want
    state = versions.read_version(spark, f"{step}/state")
    assert {r["symbol"]: r["count"] for r in state.groupBy("symbol").count().collect()} == {"a": 4, "b": 4, "late": 4, "gone": 4}
    assert len(versions.versions(spark, f"{step}/state")) == 3
    with pytest.raises(ValueError):  # older than any state kept
        run(spark, step, days(rows, 2), partition)
    assert run(spark, step, [("a", None, 1.0)], partition) is None and content(I.read_results(spark, step)) == want
