"""Streams against their batch counterparts, in several micro-batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from barloom.streaming import streams as S

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp, price double, id long"


def write_batches(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def tick(sym, hours, price, i):
    return (sym, T0 + dt.timedelta(hours=hours), float(price), i)


def test_late_ticks_are_dropped_only_beyond_the_watermark(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    for batch in ([tick("A", 1, 10, 1), tick("A", 30, 11, 2)],
                  [tick("A", 2, 99, 3), tick("A", 29.5, 12, 4)],  # the first is late, the second is not
                  [tick("A", 100, 13, 5)]):
        write_batches(spark, src, [batch])
        S.run_to_parquet(S.stream_bars(S.read_stream(spark, src)), out, cp)
    rows = {r["w"]["start"].day: (r["high"], r["volume"]) for r in spark.read.parquet(out).collect()}
    assert rows == {1: (10.0, 1), 2: (12.0, 2)}


def test_alerts_over_batches_equal_one_batch(spark, tmp_path):
    S.use_rocksdb(spark)
    prices = [10, 50, 60, 5, 5, 70, 1, 2]
    ticks = [tick(s, 24 * d + 1, p if s == "A" else 40 - p, 10 * d + k) for d, p in enumerate(prices) for k, s in enumerate("AB")]
    got = []
    for name, parts in (("many", [ticks[:4], ticks[4:10], ticks[10:]]), ("one", [ticks])):
        src, out, cp = (str(tmp_path / f"{name}-{n}") for n in ("src", "out", "cp"))
        for rows in parts:
            write_batches(spark, src, [rows])
            label = F.when(F.col("close") > 30, "HIGH").otherwise("LOW")
            S.run_to_parquet(S.stream_alerts(S.stream_bars(S.read_stream(spark, src)), label), out, cp)
        got.append({tuple(r) for r in spark.read.parquet(out).collect()})
    assert got[0] == got[1] and got[0]


def test_ordered_alerts_do_not_depend_on_batches(spark, tmp_path):
    S.use_rocksdb(spark)
    r = random.Random(5)
    rows = [tick(r.choice(["A", "B", None]), h / 4, r.randrange(60), h) for h in range(200)]
    rows += [tick("A", 10, 1, 900), tick("A", 10, 59, 901), tick("B", 11, 5, 902), ("A", None, 50.0, 903), ("A", T0, None, 904)]
    newest = rows[199][1]
    shuffled = sorted(rows, key=lambda x: ((x[1] or T0) - T0).total_seconds() / 3600 + r.uniform(0, 9))  # up to 9 hours behind
    label = F.when(F.col("price") > 30, "HIGH").when(F.col("price") <= 30, "LOW")
    got = []
    for name, parts in (("one", [rows]), ("many", [shuffled[i : i + 45] for i in range(0, len(shuffled), 45)])):
        src, out, cp = (str(tmp_path / f"{name}-{n}") for n in ("src", "out", "cp"))
        for part in parts:
            write_batches(spark, src, [part])
            S.run_to_parquet(S.stream_ordered_alerts(S.read_stream(spark, src), label, delay="10 hours"), out, cp)
        got.append(sorted((x.symbol, x.at, x.prev_label, x.label) for x in spark.read.parquet(out).filter("NOT late").collect()))
    want = []
    for s in "AB":
        by_time = {}
        for sym, t, p, _ in rows:
            if sym == s and t is not None and p is not None and t <= newest - dt.timedelta(hours=10):
                by_time[t] = max(by_time.get(t, ""), "HIGH" if p > 30 else "LOW")
        seq = sorted(by_time.items())
        want += [(s, int((t - T0).total_seconds() * 1e6) + 1704067200 * 10**6, a, b) for (_, a), (t, b) in zip(seq, seq[1:]) if a != b]
    assert got[0] == sorted(want) and got[1] == got[0] and want


def test_ordered_alerts_leave_out_late_rows(spark, tmp_path):
    S.use_rocksdb(spark)
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    label = F.when(F.col("price") > 30, "HIGH").otherwise("LOW")
    for batch in ([tick("A", 1, 10, 1), tick("A", 2, 50, 2), tick("A", 40, 10, 3)], [tick("A", 1.5, 50, 4), tick("A", 39.5, 50, 5), tick("A", 90, 1, 6)]):
        write_batches(spark, src, [batch])
        S.run_to_parquet(S.stream_ordered_alerts(S.read_stream(spark, src), label), out, cp)
    rows = spark.read.parquet(out).filter("NOT late").collect()
    hours = sorted(((x.at / 1e6 - 1704067200) / 3600, x.prev_label, x.label) for x in rows)
    assert hours == [(2.0, "LOW", "HIGH"), (40.0, "HIGH", "LOW")]


def test_upsert_stream_is_idempotent(spark, tmp_path):
    src, path = str(tmp_path / "src"), str(tmp_path / "t")
    write_batches(spark, src, [[tick("A", 1, 1, 1), tick("A", 1, 2, 2), tick("B", 1, 3, 3)]])
    for run in range(2):
        e = S.read_stream(spark, src).withColumn("day", F.to_date("ts"))
        S.stream_upsert(e, path, ["symbol", "day"], [F.col("id")], str(tmp_path / f"cp{run}"), "day").awaitTermination()
    assert {(r["symbol"], r["id"]) for r in spark.read.parquet(path).collect()} == {("A", 1), ("B", 3)}
