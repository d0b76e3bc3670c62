"""Recursive indicators against their definitions, step by step."""

import numpy as np

from tapewright.functions import recurrences as r

X = 100 + np.cumsum(np.random.default_rng(3).normal(0, 1, 200))


def test_ema_by_weights():
    a = 2 / 11
    for seed, first in (("sma", X[:10].mean()), ("first", X[0])):
        start = 9 if seed == "sma" else 0
        got = r.ema(X, 10, seed)
        assert np.isnan(got[:start]).all()
        for i in (start, start + 1, 150):
            k = i - start
            tail = X[start + 1 : i + 1]
            want = first * (1 - a) ** k + sum(a * (1 - a) ** (k - 1 - j) * v for j, v in enumerate(tail))
            assert abs(got[i] - want) < 1e-9


def test_short_histories():
    for n in (0, 1, 5):
        x = X[:n]
        for got in (r.ema(x, 10), r.dema(x, 10), r.rsi_wilder(x), r.macd_histogram(x), r.smoothed_stochastic(x, x, x, 10)):
            assert len(got) == n and np.isnan(got).all()


def test_constants_and_trends():
    flat, rise = np.full(120, 7.0), np.arange(120.0)
    assert np.allclose(r.dema(flat, 10)[18:], 7)
    assert np.allclose(r.macd_histogram(flat)[34:], 0)
    assert (r.rsi_wilder(rise)[15:] == 100).all() and np.isnan(r.rsi_wilder(rise)[:15]).all()
    assert np.allclose(r.smoothed_stochastic(flat, flat, flat, 20)[19:], 50)
    assert np.allclose(r.smoothed_stochastic(rise, rise, rise, 20)[60:], 100)
