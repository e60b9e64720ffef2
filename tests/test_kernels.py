"""Kernels against literal loops and invariants."""

import numpy as np
import pytest

from ohlcraft.functions.scalar import session_table
from ohlcraft.operators import allocation, backtest, ml, structure
from ohlcraft.operators import kernels as K

RNG = np.random.default_rng(5)
PRICE = 100 + np.cumsum(RNG.normal(0, 1, 400))


def test_recurrences_warm_up_and_constants():
    flat = np.full(50, 7.0)
    assert np.allclose(K.ema_first(flat, 5), 7) and np.isnan(K.ema_sma(flat, 5)[:4]).all() and np.allclose(K.ema_sma(flat, 5)[4:], 7)
    assert np.allclose(K.rsi(flat, 6)[6:], 0) and np.isnan(K.rsi(flat, 6)[:6]).all()
    assert np.allclose(K.rsi(np.arange(50.0), 6)[6:], 100)
    assert np.allclose(K.atr(flat + 1, flat - 1, flat, 5)[5:], 2)
    k, d, j = K.kdj(flat, flat, flat)
    assert np.allclose(k, 0) and np.allclose(3 * k - 2 * d, j)


def test_supertrend_stays_on_its_side():
    line, trend = K.supertrend(PRICE + 1, PRICE - 1, PRICE)
    on = trend != 0
    assert set(trend[on]) <= {1, -1} and np.isnan(line[~on]).all() and not np.isnan(line[on]).any()


def test_clamped_sum_is_bounded():
    p, q = K.clamped_sum(RNG.normal(0, 0.4, 500))
    assert p.min() >= 0 and p.max() <= 1 and np.array_equal(q[1:], p[:-1]) and q[0] == 0


def test_polynomial_taps_equal_a_fit():
    x = np.linspace(-1, 1, 252)
    c = np.polynomial.chebyshev.chebfit(x, PRICE[:252], 9)
    assert K.poly_end(PRICE)[251] == pytest.approx(np.polynomial.chebyshev.chebval(1.0, c))


def test_peaks_stream_equals_batch():
    y = PRICE.copy()
    y[200] += 60
    whole, held = K.zscore_peaks(y, 10, 3.0, 0.5), []
    for i, v in enumerate(y.tolist()):
        s, held = K.peak_step(held, v, 10, 3.0, 0.5)
        assert s == whole[i] and len(held) <= 10
    assert whole[200] == 1


def test_longest_chain_by_brute_force():
    for _ in range(50):
        y = RNG.integers(0, 9, 12).astype(float)
        best = max((bin(m).count("1") for m in range(1 << 12) if _rises(y[[i for i in range(12) if m >> i & 1]])), default=0)
        got = ml.increasing(y)
        assert len(got) == best and _rises(y[got])


def _rises(x):
    return bool(np.all(np.diff(x) > 0))


def test_renko_steps_are_whole_bricks():
    level, bricks, _, _ = ml.renko(PRICE, 1.5)
    assert np.allclose(np.diff(level), 1.5 * bricks[1:]) and np.all(np.abs(PRICE - level) < 1.5)


def test_model_tree_covers_and_finds_the_kink():
    y = np.concatenate([np.arange(50.0), 50 - 2 * np.arange(50.0)])
    parts = ml.model_tree(y)
    assert [p[0] for p in parts[1:]] == [p[1] for p in parts[:-1]] and parts[0][0] == 0 and parts[-1][1] == 100
    assert any(48 <= p[1] <= 52 for p in parts)


def test_modes_add_up():
    assert np.allclose(ml.emd(PRICE).sum(axis=0), PRICE) and np.allclose(ml.eemd(PRICE, 3).sum(axis=0), PRICE)


def test_structure_invariants():
    high, low = PRICE + RNG.random(400), PRICE - RNG.random(400)
    bars = structure.merge_bars(high, low)
    assert bars[0][0] == 0 and bars[-1][1] == 399 and all(a[1] + 1 == b[0] for a, b in zip(bars, bars[1:]))
    assert not any((a[2] >= b[2] and a[3] <= b[3]) or (a[2] <= b[2] and a[3] >= b[3]) for a, b in zip(bars, bars[1:]))
    points = structure.strokes(bars, structure.fractals(bars))
    assert all(a[1] != b[1] for a, b in zip(points, points[1:])) and len(points) > 5
    assert all(p["zg"] > p["zd"] for p in structure.pivots(points))


def test_containment_both_ways():
    up = structure.merge_bars(np.array([5.0, 7, 6.5]), np.array([3.0, 4, 5]))
    assert up[-1][2:] == [7, 5]
    down = structure.merge_bars(np.array([9.0, 7, 6.5]), np.array([6.0, 4, 5]))
    assert down[-1][2:] == [6.5, 4]


def test_trades():
    close = np.array([10.0, 11, 12, 13, 12, 11])
    trigger, forecast = np.array([0, 1, 0, 0, 0, 0]), np.array([0, 1, 1, 0, 0, 0])
    (t,) = backtest.run_trades(close, trigger, forecast, np.array([0, 1, 1, 1, 1, 0]), None)
    assert t["state"] == backtest.CLOSED and t["ret"] == pytest.approx(0.0) and t["forecast"] == pytest.approx(2 / 11)
    (t,) = backtest.run_trades(close, trigger, forecast, np.ones(6), None)
    assert t["state"] == backtest.HELD and t["end_price"] == 11
    assert backtest.run_trades(close, np.zeros(6), forecast, np.ones(6), None) == []
    (t,) = backtest.run_trades(close, trigger, forecast, np.ones(6), -np.ones(6))
    assert t["state"] == backtest.ENDED and t["ret"] is None and t["simulated"] is not None


def test_session_bounds():
    t = session_table(60)
    at = lambda h, m: t[h * 60 + m]
    assert at(9, 29) == 600 and at(9, 30) == 600 and at(11, 30) == 690 and at(11, 31) == 840 and at(13, 0) == 840 and at(15, 0) == 900 and at(15, 1) is None


def test_weights():
    cov = np.diag([1.0, 4.0, 2.0])
    w = allocation.min_variance(cov)
    assert w.sum() == pytest.approx(1) and np.allclose(w, np.array([4, 1, 2]) / 7, atol=1e-3)
    assert allocation.max_sharpe(np.array([0.1, 0.0, 0.0]), cov)[0] > 0.5
    s = RNG.normal(0, [1, 5, 5], (300, 3))
    assert allocation.min_cvar(s)[0] > 0.5


def test_weights_of_a_large_matrix():
    x = RNG.normal(size=(300, 2200)) * np.linspace(1, 3, 2200)
    cov = np.cov(x.T)
    assert allocation.largest_eigenvalue(cov) == pytest.approx(np.linalg.eigvalsh(cov)[-1], rel=1e-6)
    w = np.zeros((2, 2200))
    w[0, 5:40] = w[1, 30:50] = 1 / 7
    times = allocation.Products(cov)
    for some in (w, w[:1], w[1:], np.ones((1, 2200)), w):
        assert np.allclose(times(some), some @ cov)
    assert np.allclose(allocation.simplex(x[:5]), [allocation.simplex(v) for v in x[:5]])


def test_moments_of_any_number_of_symbols(spark, monkeypatch):
    x = RNG.normal(size=(4, 2100))
    rows = [(f"2024-01-{d + 1:02d} 00:00:00", s, float(x[d, s])) for d in range(4) for s in range(2100) if (d + s) % 9]
    df = spark.createDataFrame(rows, "dt string, symbol long, ret double").selectExpr("cast(dt as timestamp_ntz) as dt", "symbol", "ret")
    there = np.array([[(d + s) % 9 > 0 for s in range(2100)] for d in range(4)])
    for limit in (1 << 29, 1 << 10):  # in memory, in a file
        monkeypatch.setattr(allocation, "IN_MEMORY", limit)
        names, mean, cov = allocation.moments(df)
        assert sorted(names) == list(range(2100)) and cov.shape == (2100, 2100) and np.allclose(cov, cov.T, rtol=0, atol=1e-12)
        assert np.allclose(mean, [x[there[:, s], s].mean() for s in names])
        for i, j in RNG.integers(0, 2100, (100, 2)):
            both = there[:, names[i]] & there[:, names[j]]
            assert cov[i, j] == pytest.approx(np.cov(x[both, names[i]], x[both, names[j]])[0, 1], abs=1e-12)


def test_portfolios_of_many_symbols_need_no_whole_matrix(spark, monkeypatch):
    x = np.random.default_rng(41).normal(size=(200, 90)) * np.linspace(1, 2, 90) + np.linspace(0, 0.3, 90)
    df = spark.createDataFrame([(d, s, float(x[d, s])) for d in range(200) for s in range(90)], "d int, symbol long, ret double")
    df = df.selectExpr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, d) as dt", "symbol", "ret")
    names, mean, cov = allocation.moments(df)
    low = allocation.min_variance(cov)
    monkeypatch.setattr(allocation, "IN_MEMORY", 8 * 80 * 80)
    monkeypatch.setattr(allocation, "moments", None)  # the whole matrix would be beyond the limit
    got, least, best = allocation.portfolios(df)
    assert got == sorted(names) and np.allclose(least[names], low, atol=1e-3) and least.sum() == pytest.approx(1)
    assert np.argmin(cov @ least[names]) in np.flatnonzero(least[names]) and best.sum() == pytest.approx(1)
    ratio = lambda w: w @ mean / np.sqrt(w @ cov @ w)
    assert ratio(best[names]) > 0.98 * ratio(allocation.max_sharpe(mean, cov))
