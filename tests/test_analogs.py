"""Analogs of every date against brute force: gaps in dates, a constant feature, ties, outcomes known on the day only."""

import datetime

import numpy as np
import pytest

from barloom.operators import analogs as A

NAMES = ("f0", "f1", "f2", "f3")
START = datetime.date(2001, 3, 5)


def series(n, seed):
    r = np.random.default_rng(seed)
    days = np.cumsum(r.choice([1, 1, 1, 2, 3, 40], n, p=[0.4, 0.2, 0.2, 0.1, 0.09, 0.01]))
    x = np.cumsum(r.normal(size=(n, len(NAMES))), axis=0)
    x[:, 3] = 1.0
    x[50:60] = x[40:50]  # ties
    return [START + datetime.timedelta(int(d)) for d in days], x


def brute(dates, x, k, least, gap, history):
    out = []
    for i, day in enumerate(dates):
        old = [j for j, d in enumerate(dates) if d < day - datetime.timedelta(gap)]
        if len(old) < history:
            continue
        mean, spread = x[old].mean(0), x[old].std(0)
        spread[spread < 1e-9] = 1.0
        a, b = (x[i] - mean) / spread, (x[old] - mean) / spread
        with np.errstate(invalid="ignore", divide="ignore"):
            score = b @ a / np.sqrt((a @ a) * (b * b).sum(1))
        best = sorted((-s, dates[j]) for s, j in zip(score, old) if s >= least)[:k]
        out += [(day, d, place + 1, -s) for place, (s, d) in enumerate(best)]
    return out


@pytest.mark.parametrize("least,width", [(0.7, 64), (0.95, 512), (-1.0, 100)])
def test_history_is_the_best_of_all_older_dates(spark, least, width):
    dates, x = series(400, 1)
    df = spark.createDataFrame([(d, *map(float, v)) for d, v in zip(dates, x)], "date date, " + ", ".join(f"{f} double" for f in NAMES))
    got = A.analog_history(df, 3, least, 30, 60, NAMES, width).orderBy("date", "place").collect()
    want = brute(dates, x, 3, least, 30, 60)
    assert len(got) == len(want) > 100
    assert [(r.date, r.place) for r in got] == [(d, p) for d, _, p, _ in want]
    assert np.allclose([r.similarity for r in got], [s for *_, s in want], atol=1e-9)
    same = [r.analog_date == d for r, (_, d, _, _) in zip(got, want)]
    near = [abs(r.similarity - s) < 1e-9 for r, (*_, s) in zip(got, want)]
    assert np.mean(same) > 0.95 and all(near)  # repeated states differ by rounding only


def test_newest_date_agrees_with_the_report(spark):
    dates, x = series(300, 2)
    df = spark.createDataFrame([(d, *map(float, v)) for d, v in zip(dates, x)], "date date, " + ", ".join(f"{f} double" for f in NAMES))
    report = A.similar_states(df, 4, 0.2, names=NAMES).collect()
    newest = A.analog_history(df, 4, 0.2, names=NAMES).filter(f"date = '{dates[-1]}'").orderBy("place").collect()
    assert [(r.analog_date, round(r.similarity, 9)) for r in newest] == [(r.analog_date, round(r.similarity, 9)) for r in report]


def test_empty_history(spark):
    df = spark.createDataFrame([], "date date, " + ", ".join(f"{f} double" for f in NAMES))
    assert A.analog_history(df, names=NAMES).count() == 0


def test_outcomes_are_known_on_the_date(spark):
    day = lambda i: START + datetime.timedelta(i)
    bars = spark.createDataFrame([("a", day(i), 100.0 + i) for i in range(0, 40, 2)], "symbol string, date date, close double")
    pairs = spark.createDataFrame([(day(13), day(3)), (day(30), day(3)), (day(30), day(28))], "date date, analog_date date")
    got = {(r.date, r.analog_date, r.horizon): r.forward_return for r in A.history_outcomes(pairs, bars, ["a", "b"], (5, 10)).collect()}
    # the nearest bar of day 3 is day 2 (the earlier one); five bars on is day 12, ten bars day 22
    assert got == {(day(13), day(3), 5): (112 / 102 - 1) * 100, (day(30), day(3), 5): (112 / 102 - 1) * 100, (day(30), day(3), 10): (122 / 102 - 1) * 100}
