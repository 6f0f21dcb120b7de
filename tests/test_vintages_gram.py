"""Values as published and revised, and correlations by blocks of members, against brute force."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators.gram import block_corr
from barloom.operators.vintages import known_asof

DAY = datetime.date(2020, 1, 1)


def day(i):
    return DAY + datetime.timedelta(days=i)


def brute(left, prints):
    out = []
    for key, t, tag in left:
        known = [(p, pub, v) for k, p, pub, v in prints if None not in (k, p, pub) and t is not None and k == key and pub <= t]
        best = max(known, key=lambda x: (x[0], x[1], x[2] is not None, x[2] or 0)) if known else (None, None, None)
        out.append((key, t, tag, best[2], best[0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_rows", [None, 40])
def test_known_asof(spark, most_rows):
    r = random.Random(3)
    prints = [("a" if r.random() < 0.9 else r.choice(["b", None]), day(p := r.randrange(0, 900)), day(p + r.randrange(1, 400)), r.choice([None, *map(float, range(9))])) for _ in range(600)]
    prints += [("a", None, day(3), 1.0), ("a", day(3), None, 1.0), ("b", day(5), day(6), 1.0), ("b", day(5), day(6), 2.0)]
    left = [(r.choice(["a", "b", "c", None]), day(r.randrange(0, 1400)), i) for i in range(300)] + [("a", None, 900), ("b", day(6), 901), ("b", day(6), 901)]
    l = spark.createDataFrame(left, "symbol string, date date, tag int")
    p = spark.createDataFrame(prints, "symbol string, period date, published date, value double")
    got = known_asof(l, p, ["value"], keep_period="at", most_rows=most_rows)
    assert got.columns == ["symbol", "date", "tag", "value", "at"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(left, prints)
    assert known_asof(l.limit(0), p, ["value"]).count() == 0
    assert known_asof(l, p.limit(0), ["value"]).filter("value IS NULL").count() == len(left)


def test_block_corr(spark):
    g = np.random.default_rng(4)
    base = g.normal(size=300)
    rows = []
    for m in range(60):
        for d in range(300):
            if g.random() < 0.7 and (m != 5 or d < 40) and (m != 6 or d >= 40):  # 5 and 6 share no date
                rows.append((f"m{m:02}", day(d), float(1e6 * (m == 7) + base[d] * m / 30 + g.normal())))
    rows += [("flat", day(d), 0.1) for d in range(300)] + [("part", day(d), 0.3 if d else 9.0) for d in range(300)] + [("one", day(7), 1.0)]
    twice = [("m01", day(0), 1.0), ("m01", day(0), 4.0)]
    odd = [(None, day(1), 1.0), ("m02", None, 1.0), ("m02", day(1), None), ("m02", day(1), float("nan"))]
    rows = [x for x in rows if x[:2] != ("m01", day(0)) and x[:2] != ("m02", day(1)) and x[:2] != ("one", day(0))]
    got = block_corr(spark.createDataFrame(rows + twice + odd, "symbol string, date date, ret double"), block=16, days=90)
    got = {(r.a, r.b): (r.n, r["corr"]) for r in got.collect()}
    wide = pd.DataFrame(rows + [("m01", day(0), 2.5)], columns=["m", "d", "x"]).pivot(index="d", columns="m", values="x")
    names, n_pairs = sorted(wide.columns), 0
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = wide[[a, b]].dropna()
            if both.empty:
                assert (a, b) not in got
                continue
            n_pairs += 1
            n, c = got[a, b]
            assert n == len(both)
            if n < 2 or both[a].nunique() == 1 or both[b].nunique() == 1:
                assert c is None, (a, b, c)
            else:
                assert c == pytest.approx(both[a].corr(both[b]), abs=1e-8)
    assert len(got) == n_pairs and ("m05", "m06") not in got


def test_block_corr_is_spread_and_empty(spark):
    empty = spark.createDataFrame([], "symbol string, date date, ret double")
    assert block_corr(empty).count() == 0
    df = spark.range(40 * 500).select(F.concat(F.lit("m"), (F.col("id") % 40).cast("string")).alias("symbol"), F.date_add(F.lit(DAY), (F.col("id") / 40).cast("int")).alias("date"), F.rand(1).alias("ret"))
    assert block_corr(df, block=10, days=100).agg(F.count("*"), F.min("n"), F.max("n")).first()[:] == (780, 500, 500)
