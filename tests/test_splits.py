"""Equal-count splits: a hot symbol, hour, second and instant are spread; order, joins and numbering stay right."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators.align import asof_join
from barloom.operators.chunking import number_rows
from barloom.operators.splits import micros, split_evenly

MOST = 100


def ticks(n=6000):
    """(symbol, ts, id, price): 90 % of the rows in one hour of one symbol, half of these in a second, a third at one instant."""
    r = random.Random(7)
    start = datetime.datetime(2024, 3, 31, 1)
    out = []
    for i in range(n):
        if i % 10 == 0:
            symbol, ts = r.choice(["b", "c", None]), start + datetime.timedelta(hours=r.randrange(200), seconds=r.randrange(3600))
        else:
            step = r.random()
            off = 777_000_123 if step < 0.33 else 777_000_000 + r.randrange(1_000_000) if step < 0.5 else r.randrange(3_600_000_000)
            symbol, ts = "a", start + datetime.timedelta(hours=1, microseconds=off)
        out.append((symbol, ts, i, float(r.randrange(100))))
    return out


@pytest.fixture(scope="module")
def rows():
    return ticks()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id long, price double")


def test_splits_are_even_and_in_order(df):
    d = split_evenly(df, ["symbol"], "ts", F.col("id"), MOST).collect()
    sizes, last = {}, {}
    for r in sorted(d, key=lambda r: (str(r.symbol), r.ts, r.id)):
        sizes[r.symbol, r._split] = sizes.get((r.symbol, r._split), 0) + 1
        assert last.get(r.symbol, -1) <= r._split
        last[r.symbol] = r._split
    assert sum(sizes.values()) == df.count() and max(sizes.values()) <= 2 * MOST
    assert len([k for k in sizes if k[0] == "a"]) >= 40
    assert len([k for k in sizes if k[0] == "b"]) <= 5  # 200 quiet hours are not cut into as many


def test_tasks_get_even_shares(df):
    d = split_evenly(df, ["symbol"], "ts", F.col("id"), MOST)
    per_task = d.repartition(64, "symbol", "_split").groupBy(F.spark_partition_id().alias("p")).count()
    assert per_task.agg(F.max("count")).first()[0] <= 6 * MOST  # a hot symbol-hour holds 5,400 rows


def test_row_numbers(df, rows):
    d = split_evenly(df.filter("symbol IS NOT NULL"), ["symbol"], "ts", F.col("id"), MOST)
    got = {r.id: r.rn for r in number_rows(d, ["symbol"], ["ts", "id"], F.col("_split")).collect()}
    for symbol in "abc":
        order = sorted((ts, i) for s, ts, i, _ in rows if s == symbol)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("equal", [True, False])
def test_asof(df, rows, direction, equal):
    right = df.filter("symbol IS NOT NULL").groupBy("symbol", "ts").agg(F.max("id").alias("last")).filter("last % 3 = 0")
    left = df.filter("symbol IS NOT NULL")
    got = {r.id: r.last for r in asof_join(left, right, ["last"], on="ts", direction=direction, allow_equal=equal, most_rows=MOST).collect()}
    want = {r.id: r.last for r in asof_join(left, right, ["last"], on="ts", direction=direction, allow_equal=equal, bucket=lambda x: F.date_trunc("day", x)).collect()}
    assert got == want and len(got) == sum(s is not None for s, *_ in rows)


def test_time_without_zone_keeps_its_order(spark):
    """The hours of a change to daylight saving time, in a session of such a zone."""
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        start = datetime.datetime(2024, 3, 31, 0, 30, 0, 250_000)
        times = [start + datetime.timedelta(minutes=10 * i) for i in range(30)]
        d = spark.createDataFrame([(t, t.date()) for t in times], "ts timestamp_ntz, d date")
        got = [r[0] for r in d.select(micros(d, "ts")).collect()]
        assert [b - a for a, b in zip(got, got[1:])] == [600_000_000] * 29
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_empty(df):
    assert split_evenly(df.filter("false"), ["symbol"], "ts").count() == 0
