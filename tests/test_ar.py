"""AR(p) fits and forecasts against least squares, and gap statistics that look back only."""

import datetime

import numpy as np
import pytest

from barloom.operators import backtest as B
from barloom.operators import market as M


@pytest.mark.parametrize("p", [1, 3, 5])
def test_ar_p(spark, p):
    r, n, h = np.random.default_rng(p), 60, 7
    ret = r.normal(0, 0.01, 130)
    for i in range(2, 130):
        ret[i] += 0.4 * ret[i - 1] - 0.3 * ret[i - 2]
    close = 100 * np.cumprod(1 + ret)
    rows = [("a", datetime.date(2020, 1, 1) + datetime.timedelta(i), float(c), None if i == 0 else float(ret[i])) for i, c in enumerate(close)]
    rows += [("flat", d, 5.0, 0.0) for _, d, *_ in rows]
    df = spark.createDataFrame(rows, "symbol string, date date, close double, ret double")
    got = {(x.symbol, x.date): x for x in B.ar_forecast(df, h, n, p).collect()}
    fit = {(x.symbol, x.date): x for x in B.ar_fit_p(df, p, n).collect()}
    for t, (_, day, price, _) in enumerate(rows[:130]):
        use = range(t - n + 1, t + 1)
        if use[0] - p < 1:
            assert got["a", day].forecast is None and fit["a", day].ar_b is None
            continue
        x = np.array([[1.0] + [ret[i - k] for k in range(1, p + 1)] for i in use])
        a, *b = np.linalg.lstsq(x, ret[list(use)], rcond=None)[0]
        assert np.allclose([fit["a", day].ar_a, *fit["a", day].ar_b], [a, *b], atol=1e-9)
        last, value = [ret[t - k] for k in range(p)], price
        for _ in range(h):
            step = a + np.dot(b, last)
            last, value = [step, *last[:-1]], value * (1 + step)
        assert abs(got["a", day].forecast - value) < 1e-6
    assert all(fit["flat", d].ar_b is None for s, d in fit if s == "flat")


def test_fill_rates_are_those_of_earlier_gaps(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(60):
        prev, gap = 100.0, float(r.choice([-0.6, 0.01, 0.4, 0.7]))
        rows.append(("a", datetime.date(2021, 1, 1) + datetime.timedelta(i), prev, gap, "UP" if gap >= 0 else "DOWN", "S" if abs(gap) < 0.5 else "L", 99.0 + 2 * float(r.random()), 100.0 + 2 * float(r.random()) - 1))
    cols = "symbol string, date date, prev_close double, gap_pct double, direction string, gap_size string, low double, high double"
    got = {x.date: x.fill_rate for x in M.fill_rate_before(spark.createDataFrame(rows, cols)).collect()}
    for i, row in enumerate(rows):
        old = [(low <= prev) if way == "UP" else (high >= prev) for _, _, prev, pct, way, size, low, high in rows[:i] if size == row[5] and abs(pct) > 0.05]
        assert got[row[1]] == (pytest.approx(np.mean(old)) if len(old) >= 5 else None)
