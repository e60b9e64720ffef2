"""Recurrences of one symbol as numpy kernels: array in, array out. Warm-up values are NaN and become null."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def ema_first(x: np.ndarray, n: int) -> np.ndarray:
    """Exponential mean seeded with the first value: (2x + (n-1)e) / (n+1)."""
    out = np.empty(len(x))
    e = np.nan
    for i, v in enumerate(x.tolist()):
        e = v if i == 0 else (2 * v + e * (n - 1)) / (n + 1)
        out[i] = e
    return out


def _seeded(x: np.ndarray, n: int, step: Callable[[float, float], float]) -> np.ndarray:
    """Recurrence seeded with the mean of the first n values that are there; NaN before."""
    out = np.full(len(x), np.nan)
    start = int(np.argmax(~np.isnan(x))) if len(x) and not np.isnan(x).all() else len(x)
    if len(x) - start < n:
        return out
    e = float(np.mean(x[start : start + n]))
    out[start + n - 1] = e
    for i in range(start + n, len(x)):
        e = step(e, float(x[i]))
        out[i] = e
    return out


def ema_sma(x: np.ndarray, n: int) -> np.ndarray:
    k = 2.0 / (n + 1)
    return _seeded(x, n, lambda e, v: e + k * (v - e))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return _seeded(x, n, lambda e, v: (e * (n - 1) + v) / n)


def macd(c: np.ndarray, short: int = 12, long: int = 26, m: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dif = ema_first(c, short) - ema_first(c, long)
    dea = ema_first(dif, m)
    return dif, dea, 2 * (dif - dea)


def rolling(x: np.ndarray, n: int, how: str) -> np.ndarray:
    """Partial windows at the start."""
    return getattr(pd.Series(x).rolling(n, min_periods=1), how)().to_numpy()


def cents(x: np.ndarray) -> np.ndarray:
    """Two places, halves up."""
    return np.floor((x + 1e-5) * 100 + 0.5) / 100


def kdj(h: np.ndarray, low: np.ndarray, c: np.ndarray, n: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hh, ll = cents(rolling(h, n, "max")), cents(rolling(low, n, "min"))
    span = hh - ll
    rsv = np.where(span == 0, 0.0, (c - ll) / np.where(span == 0, 1.0, span) * 100)
    k, d = rsv.copy(), rsv.copy()
    for i in range(max(1, n - 1), len(c)):
        k[i] = k[i - 1] * 2 / 3 + rsv[i] / 3
        d[i] = d[i - 1] * 2 / 3 + k[i] / 3
    return k, d, 3 * k - 2 * d


def rsi(c: np.ndarray, n: int) -> np.ndarray:
    d = np.diff(c, prepend=np.nan)
    up, down = wilder(np.where(np.isnan(d), np.nan, np.maximum(d, 0)), n), wilder(np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), n)
    both = up + down
    return np.where(both == 0, 0.0, 100 * up / np.where(both == 0, 1.0, both)) + 0 * both


def true_range(h: np.ndarray, low: np.ndarray, c: np.ndarray) -> np.ndarray:
    before = np.concatenate(([np.nan], c[:-1]))
    return np.maximum(h - low, np.maximum(np.abs(h - before), np.abs(low - before)))


def atr(h: np.ndarray, low: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    return wilder(true_range(h, low, c), n)


def cci(h: np.ndarray, low: np.ndarray, c: np.ndarray, n: int = 14) -> np.ndarray:
    tp = (h + low + c) / 3
    out = np.full(len(tp), np.nan)
    if len(tp) < n:
        return out
    win = np.lib.stride_tricks.sliding_window_view(tp, n)
    m = win.mean(axis=1)
    dev = np.abs(win - m[:, None]).mean(axis=1)
    out[n - 1 :] = np.where(dev == 0, 0.0, (tp[n - 1 :] - m) / np.where(dev == 0, 1.0, 0.015 * dev))
    return out


def supertrend(h: np.ndarray, low: np.ndarray, c: np.ndarray, factor: float = 3.0, n: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(line, trend): bands (h+l)/2 -+ factor ATR that ratchet while the close stays beyond them; trend 1 or -1."""
    mid, a = (h + low) / 2, atr(h, low, c, n)
    up, dn = mid - factor * a, mid + factor * a
    line, trend = np.full(len(c), np.nan), np.zeros(len(c), np.int64)
    u = d = np.nan
    t = 1
    for i in range(len(c)):
        if np.isnan(a[i]):
            continue
        before = c[i - 1] if i else np.nan
        nu = max(up[i], u) if before > u else up[i]
        nd = min(dn[i], d) if before < d else dn[i]
        if t == -1 and c[i] > d:
            t = 1
        elif t == 1 and c[i] < u:
            t = -1
        u, d = nu, nd
        line[i], trend[i] = (u if t == 1 else d), t
    return line, trend


def stop_line(o: np.ndarray, h: np.ndarray, low: np.ndarray, c: np.ndarray, n: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(upper, lower, direction): EMA of ohlc/4 +- ATR; direction of the last close beyond a band, carried forward."""
    mid, a = ema_sma((o + h + low + c) / 4, n), atr(h, low, c, n)
    ub, lb = mid + a, mid - a
    out, t = np.zeros(len(c), np.int64), 0
    for i in range(1, len(c)):
        if c[i] > ub[i] and not c[i - 1] > ub[i - 1]:
            t = 1
        elif c[i] < lb[i] and not c[i - 1] < lb[i - 1]:
            t = -1
        out[i] = t
    return ub, lb, out


def accumulation(h: np.ndarray, low: np.ndarray, c: np.ndarray, v: np.ndarray) -> np.ndarray:
    span = h - low
    return np.cumsum(np.where(span == 0, 0.0, ((c - low) - (h - c)) / np.where(span == 0, 1.0, span) * v))


def adosc(ad: np.ndarray, fast: int = 3, slow: int = 10) -> np.ndarray:
    out = ema_first(ad, fast) - ema_first(ad, slow)
    out[: slow - 1] = np.nan
    return out


def wma(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = np.lib.stride_tricks.sliding_window_view(x, n) @ (np.arange(1, n + 1) / (n * (n + 1) / 2))
    return out


def hma(x: np.ndarray, n: int) -> np.ndarray:
    return wma(2 * wma(x, max(1, n // 2)) - wma(x, n), max(1, int(n**0.5 + 0.5)))


def volume_hma(c: np.ndarray, v: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(line, direction in {-2, 0, 2}): Hull mean of EMA(c v)/EMA(v); sign against one and two bars before."""
    line = hma(ema_sma(c * v, n) / ema_sma(v, n), n)
    out = np.zeros(len(c), np.int64)
    for k in (1, 2):
        d = line[k:] - line[:-k]
        out[k:] += np.where(d > 0, 1, np.where(d < 0, -1, 0))
    return line, np.where(np.abs(out) == 2, out, 0)


def linreg_band(h: np.ndarray, low: np.ndarray, c: np.ndarray, n: int = 20, m: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, upper, lower, direction): end of the regression line +- ATR."""
    line = np.full(len(c), np.nan)
    if len(c) >= n:
        x = np.arange(n) - (n - 1) / 2
        win = np.lib.stride_tricks.sliding_window_view(c, n)
        line[n - 1 :] = win.mean(axis=1) + (win @ x) / (x @ x) * (n - 1) / 2
    a = atr(h, low, c, m)
    d = np.diff(line, prepend=np.nan)
    return line, line + a, line - a, np.where(d > 0, 1, np.where(d < 0, -1, 0))


def clamped_sum(x: np.ndarray, low: float = 0.0, high: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(position, position before): running sum held within bounds."""
    out, p = np.empty(len(x)), 0.0
    for i, v in enumerate(x.tolist()):
        p = min(high, max(low, p + v))
        out[i] = p
    return out, np.concatenate(([0.0], out[:-1]))


def peak_step(held: Sequence[float], value: float, lag: int, threshold: float, influence: float) -> tuple[int, list[float]]:
    """One value of the robust z-score detector: (signal, filtered values kept)."""
    if len(held) < lag:
        return 0, [*held, value]
    mean, sd = float(np.mean(held)), float(np.std(held))
    if abs(value - mean) > threshold * sd:
        signal = 1 if value > mean else -1
        value = influence * value + (1 - influence) * held[-1]
    else:
        signal = 0
    return signal, [*held[1:], value]


def zscore_peaks(x: np.ndarray, lag: int, threshold: float, influence: float) -> np.ndarray:
    out, held = np.zeros(len(x), np.int64), []
    for i, v in enumerate(x.tolist()):
        out[i], held = peak_step(held, v, lag, threshold, influence)
    return out


def peak_points(x: np.ndarray) -> np.ndarray:
    """Two detectors, weighted 9 and 8."""
    return 9 * zscore_peaks(x, 5, 2.0, 0.5) + 8 * zscore_peaks(x, 10, 3.0, 0.5)


def eager_extrema(c: np.ndarray, n: int = 10, apart: int = 5) -> np.ndarray:
    """Extrema of the Hull mean at least `apart` bars from each other, higher first: 1 low, -1 high."""
    line = hma(c, n)
    out = np.zeros(len(c), np.int64)
    for sign in (1, -1):
        y = -sign * line  # peaks of y
        spots = [i for i in range(1, len(y) - 1) if y[i] > y[i - 1] and y[i] >= y[i + 1]]
        taken: list[int] = []
        for i in sorted(spots, key=lambda i: -y[i]):
            if all(abs(i - j) > apart for j in taken):
                taken.append(i)
        out[taken] = sign
    return out


def variable_median(x: np.ndarray, n: int) -> np.ndarray:
    """Rolling median of absolute values over a window that comes from the data."""
    return pd.Series(np.abs(x)).rolling(max(1, n)).median().to_numpy()


def bars_since(flag: np.ndarray) -> np.ndarray:
    at = np.where(flag, np.arange(1, len(flag) + 1), 0)
    return np.arange(1, len(flag) + 1) - np.maximum.accumulate(at) if len(flag) else at


def density(jx: np.ndarray, sx: np.ndarray) -> tuple[int, np.ndarray]:
    """(window, share): 1 - the share of bars-since-cross sums over 3.09 times the smaller median of both counts."""
    a, b = bars_since(jx).astype(float), bars_since(sx).astype(float)
    n = max(2, int(3.09 * min(np.median(a), np.median(b)))) if len(a) else 2
    s, t = rolling(a, n, "sum"), rolling(b, n, "sum")
    return n, 1 - s / np.where(s + t == 0, 1.0, s + t)


def chebyshev_taps(window: int = 252, degree: int = 9) -> np.ndarray:
    """Weights that give the last value of a least-squares polynomial: the last row of the hat matrix."""
    x = np.linspace(-1, 1, window)
    v = np.polynomial.chebyshev.chebvander(x, degree)
    return v[-1] @ np.linalg.pinv(v)


def poly_end(c: np.ndarray, window: int = 252, degree: int = 9) -> np.ndarray:
    out = np.full(len(c), np.nan)
    if len(c) >= window:
        out[window - 1 :] = np.lib.stride_tricks.sliding_window_view(c, window) @ chebyshev_taps(window, degree)
    return out


def by_symbol(
    df: DataFrame, columns: Sequence[str], schema: str, kernel: Callable[..., dict[str, np.ndarray]], order: str = "dt", keep: Sequence[str] = ()
) -> DataFrame:
    """Run a kernel once for each symbol on its ordered columns and append what it returns; one exchange on symbol.

    schema lists the new columns. Columns of keep stay Arrow columns all the way, so strings, nulls and long integers come
    back as they went. A column of keep named as a new one gives way to it.
    """
    names = [x.strip().split()[0] for x in schema.split(",")]
    stay = [c for c in dict.fromkeys(keep) if c not in ("symbol", order, *names)]

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(order, "ascending")]))
        found = kernel(*[table[c].cast(pa.float64()).to_numpy() for c in columns])
        new = [pa.array(found[n], from_pandas=True) for n in names]  # NaN becomes null
        return pa.table([table[c] for c in ("symbol", order, *stay)] + new, names=["symbol", order, *stay, *names])

    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    only = df.select("symbol", order, *[c for c in dict.fromkeys([*columns, *stay]) if c not in ("symbol", order)])
    kept = "".join(f"`{c}` {kind[c]}, " for c in ("symbol", order, *stay))
    return only.groupBy("symbol").applyInArrow(run, kept + schema)
