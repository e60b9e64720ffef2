"""Learning and signal kernels of one symbol: renko bricks, waves, model trees, decompositions, fits, clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import window as W
from . import kernels as K
from .indicators import with_kernel


def renko(price: np.ndarray, brick: float, percent: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(level, bricks, low, high) for each bar: whole bricks the price has moved from the last level, signed."""
    n = len(price)
    level, bricks = np.empty(n), np.zeros(n, np.int64)
    last = price[0] if n else 0.0
    for i, p in enumerate(price.tolist()):
        size = last * brick if percent else brick
        if size > 0 and abs(p - last) >= size:
            k = int((p - last) / size)
            last += k * size
            bricks[i] = k
        level[i] = last
    size = level * brick if percent else np.full(n, brick)
    return level, bricks, level - size, level + size


def renko_score(price: np.ndarray, brick: float) -> float:
    """Gain for bricks that go on, loss for turns; log of balance per change times log of the price range, or -1."""
    if not brick > 0:
        return -1.0
    _, b, _, _ = renko(price, brick)
    moves = np.sign(b[b != 0])
    if len(moves) < 2:
        return -1.0
    turns = int(np.sum(moves[1:] != moves[:-1]))
    balance = len(moves) - 1 - turns - 2 * turns
    ratio = max(price[-1], price[0]) / min(price[-1], price[0]) if min(price[-1], price[0]) > 0 else 1.0
    if balance <= 0 or turns == 0 or ratio <= 1:
        return -1.0
    return float(np.log(balance / turns + 1) * np.log(ratio))


def bounded_maximum(f, low: float, high: float, steps: int = 40) -> float:
    """Golden-section search."""
    g = (5**0.5 - 1) / 2
    a, b = low, high
    x, y = b - g * (b - a), a + g * (b - a)
    fx, fy = f(x), f(y)
    for _ in range(steps):
        if fx >= fy:
            b, y, fy = y, x, fx
            x = b - g * (b - a)
            fx = f(x)
        else:
            a, x, fx = x, y, fy
            y = a + g * (b - a)
            fy = f(y)
    return (a + b) / 2


def best_brick(price: np.ndarray, atr: np.ndarray, chunk: int = 1200) -> np.ndarray:
    """Brick of the best score between the least and the greatest ATR, for each chunk of bars."""
    out = np.zeros(len(price))
    for i in range(0, len(price), chunk):
        a = atr[i : i + chunk]
        a = a[~np.isnan(a)]
        if len(a) and a.max() > a.min():
            out[i : i + chunk] = bounded_maximum(lambda x: renko_score(price[i : i + chunk], x), a.min(), a.max())  # noqa: B023
        elif len(a):
            out[i : i + chunk] = a[0]
    return out


def renko_frame(bars: DataFrame) -> DataFrame:
    """Bricks of the median ATR14 (S) and of the best brick (L), their directions, agreement and signed runs."""

    def kernel(h, low, c) -> dict:
        a = K.atr(h, low, c, 14)
        fixed = float(np.nanmedian(a)) if not np.isnan(a).all() else 0.0
        ls, bs, _, _ = renko(c, fixed)
        best = best_brick(c, a)
        ll, bl, _, _ = renko(c, float(np.median(best)))

        def way(b: np.ndarray) -> np.ndarray:
            s, out = 0, np.zeros(len(b), np.int64)
            for i, k in enumerate(b.tolist()):
                s = int(np.sign(k)) or s
                out[i] = s
            return out

        return {"s_level": ls, "s_bricks": bs, "s_way": way(bs), "l_level": ll, "l_bricks": bl, "l_way": way(bl), "brick": best}

    schema = "s_level double, s_bricks bigint, s_way bigint, l_level double, l_bricks bigint, l_way bigint, brick double"
    df = W.numbered(with_kernel(bars, ["high", "low", "close"], schema, kernel))
    both = F.when(F.col("s_way") == F.col("l_way"), F.col("s_way")).otherwise(0)
    df = df.withColumn("trend", both.cast("bigint"))
    return df.withColumns({"s_run": W.signed_run(F.col("s_way")), "l_run": W.signed_run(F.col("l_way")), "run": W.signed_run(F.col("trend"))})


def increasing(values: np.ndarray) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting."""
    tails: list[int] = []
    before = [-1] * len(values)
    keys: list[float] = []
    for i, v in enumerate(values.tolist()):
        k = int(np.searchsorted(keys, v))
        before[i] = tails[k - 1] if k else -1
        if k == len(tails):
            tails.append(i)
            keys.append(v)
        else:
            tails[k], keys[k] = i, v
    out, i = [], tails[-1] if tails else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def wave_marks(low: np.ndarray, high: np.ndarray, reach: int = 5) -> np.ndarray:
    """1 at local lows on a longest rising chain, -1 at local highs on a longest falling chain."""
    n = len(low)
    out = np.zeros(n, np.int64)
    lows = [i for i in range(n) if low[i] == low[max(0, i - reach) : i + reach + 1].min()]
    highs = [i for i in range(n) if high[i] == high[max(0, i - reach) : i + reach + 1].max()]
    for k in increasing(low[lows]):
        out[lows[k]] = 1
    for k in increasing(-high[highs]):
        out[highs[k]] = -1
    return out


def waves(bars: DataFrame) -> DataFrame:
    return with_kernel(bars, ["low", "high"], "wave bigint", lambda low, high: {"wave": wave_marks(low, high)})


class _Sums:
    """Prefix sums for the error of a regression line on any stretch in constant time."""

    def __init__(self, y: np.ndarray) -> None:
        x = np.arange(len(y), dtype=float)
        y = y - y.mean() if len(y) else y
        self.s = [np.concatenate(([0.0], np.cumsum(v))) for v in (x, y, x * x, x * y, y * y)]

    def fit(self, i, j):
        """(slope, intercept, squared error) of rows i to j; arrays allowed."""
        n = np.maximum(j - i, 1)
        sx, sy, sxx, sxy, syy = (s[j] - s[i] for s in self.s)
        d = n * sxx - sx * sx
        slope = np.where(d > 0, (n * sxy - sx * sy) / np.where(d > 0, d, 1), 0.0)
        inter = (sy - slope * sx) / n
        return slope, inter, np.maximum(syy - inter * sy - slope * sxy, 0.0)


def model_tree(y: np.ndarray, least: int = 10, gain: float = 0.05) -> list[tuple[int, int]]:
    """Stretches of a piecewise linear fit: split where the errors of two lines are least, while it gains enough."""
    if not len(y):
        return []
    sums = _Sums(y)
    out, stack = [], [(0, len(y))]
    while stack:
        i, j = stack.pop()
        whole = float(sums.fit(i, j)[2])
        if j - i >= 2 * least and whole > 0:
            cut = np.arange(i + least, j - least + 1)
            error = sums.fit(i, cut)[2] + sums.fit(cut, j)[2]
            k = int(np.argmin(error))
            if error[k] < whole * (1 - gain):
                stack += [(int(cut[k]), j), (i, int(cut[k]))]
                continue
        out.append((i, j))
    return sorted(out)


def tree_frame(bars: DataFrame, last: int = 300) -> DataFrame:
    """Model tree of the Hull mean's last bars: fitted price, trend, slope and the age of the stretch."""

    def kernel(c) -> dict:
        line = K.hma(c, 10)
        price, slope, age = np.full(len(c), np.nan), np.full(len(c), np.nan), np.zeros(len(c), np.int64)
        first = max(len(c) - last, int(np.argmax(~np.isnan(line))) if not np.isnan(line).all() else len(c))
        y = line[first:]
        sums = _Sums(y)
        mean = y.mean() if len(y) else 0.0
        for i, j in model_tree(y):
            a, b, _ = sums.fit(i, j)
            x = np.arange(i, j)
            price[first + i : first + j] = a * x + b + mean
            slope[first + i : first + j] = a
            age[first + i : first + j] = x - i
        trend = np.where(slope > 0, 1, np.where(slope < 0, -1, 0)).astype(np.int64)
        return {"tree_price": price, "tree_slope": slope, "tree_trend": trend, "tree_age": age}

    return with_kernel(bars, ["close"], "tree_price double, tree_slope double, tree_trend bigint, tree_age bigint", kernel)


def _envelope(y: np.ndarray, knot: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Natural cubic splines through the knots of series that lie end to end, each with a knot at both its ends. The second
    derivatives of all come from one cyclic reduction: its rows are dominated by their diagonals, so the rest of the
    coupling squares in each step and is nothing after a few."""
    x = np.flatnonzero(knot)
    value = y[x]
    h = np.diff(x, append=x[-1] + 1).astype(float)
    slope = np.diff(value, append=value[-1]) / h
    end = np.zeros(len(x) + 1, bool)
    tail = np.searchsorted(x, last)
    end[0] = end[tail] = end[tail + 1] = True
    end = end[:-1]
    before = np.concatenate(([1.0], h[:-1]))
    d = 2 * (before + h)
    a, c = np.where(end, 0.0, before / d), np.where(end, 0.0, h / d)
    r = np.where(end, 0.0, 6 * (slope - np.concatenate(([0.0], slope[:-1]))) / d)
    step = 1
    while step < len(x) and max(a.max(), c.max(), -a.min(), -c.min()) > 1e-17:
        low, high = (lambda v: np.concatenate((np.zeros(step), v[:-step]))), (lambda v: np.concatenate((v[step:], np.zeros(step))))  # noqa: B023
        scale = 1 / (1 - a * low(c) - c * high(a))
        r = (r - a * low(r) - c * high(r)) * scale
        a, c = -a * low(a) * scale, -c * high(c) * scale
        step *= 2
    after = np.append(r[1:], 0.0)
    where = np.repeat(np.arange(len(x)), np.diff(x, append=len(y)))
    e = np.arange(len(y), dtype=float)
    e -= x.astype(float)[where]
    out = ((after - r) / (6 * h))[where]
    for part in (r / 2, slope - h * (2 * r + after) / 6, value):
        out *= e
        out += part[where]
    out[last] = y[last]
    return out


def emd_many(series: list[np.ndarray], most: int = 8, sifts: int = 10) -> list[np.ndarray]:
    """Intrinsic modes of each series by sifting, all together; the last row of each is the rest, rows add up to the series."""
    rest = [np.array(y, float) for y in series]
    out: list[list[np.ndarray]] = [[] for _ in series]
    on = [i for i, y in enumerate(rest) if len(y) > 2 and np.isfinite(y).all()]
    for _ in range(most):
        h = [rest[i] for i in on]
        for _ in range(sifts):
            if not on:
                break
            flat, sizes = np.concatenate(h), np.array([len(y) for y in h])
            last = np.cumsum(sizes) - 1
            first = last - sizes + 1
            up, down = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
            rise, fall = flat[1:] > flat[:-1], flat[1:] < flat[:-1]
            np.greater(rise[:-1], rise[1:], out=up[1:-1])  # up to here, and no further up
            np.greater(fall[:-1], fall[1:], out=down[1:-1])
            for f in (up, down):
                f[first] = f[last] = False
            go = (np.add.reduceat(up, first, dtype=int) >= 2) & (np.add.reduceat(down, first, dtype=int) >= 2)
            if not go.all():
                kept = np.repeat(go, sizes)
                on = [i for i, g in zip(on, go) if g]
                if not on:
                    break
                flat, up, down, sizes = flat[kept], up[kept], down[kept], sizes[go]
                last = np.cumsum(sizes) - 1
                first = last - sizes + 1
            for f in (up, down):
                f[first] = f[last] = True
            flat = flat - (_envelope(flat, up, last) + _envelope(flat, down, last)) / 2
            h = np.split(flat, first[1:])
        for i, y in zip(on, h if on else ()):
            out[i].append(y)
            rest[i] = rest[i] - y
    return [np.array([*m, y]) for m, y in zip(out, rest)]


def emd(y: np.ndarray, most: int = 8, sifts: int = 10) -> np.ndarray:
    """Intrinsic modes by sifting; the last row is the rest, rows add up to y."""
    return emd_many([y], most, sifts)[0]


def eemd_many(series: list[np.ndarray], trials: int = 20, noise: float = 0.1, seed: int = 12345, most: int = 6) -> list[np.ndarray]:
    """Mean modes of each series over trials with added noise, which starts anew for each; the rest row is set so that rows
    add up to the series."""
    out = [np.zeros((most + 1, len(y))) for y in series]
    held: list[tuple[int, np.ndarray]] = []

    def add() -> None:
        for (k, _), m in zip(held, emd_many([y for _, y in held], most)):
            out[k][: len(m) - 1] += m[:-1]
        held.clear()

    for k, y in enumerate(series):
        rng, scale = np.random.default_rng(seed), noise * (np.std(y) or 1.0)
        for _ in range(trials):
            held.append((k, y + scale * rng.standard_normal(len(y))))
            if len(held) * max(len(y), len(held[0][1])) >= 30000:  # about so many values stay in the processor's cache
                add()
    add()
    for y, total in zip(series, out):
        total /= trials
        total[-1] = y - total[:-1].sum(axis=0)
    return out


def eemd(y: np.ndarray, trials: int = 20, noise: float = 0.1, seed: int = 12345, most: int = 6) -> np.ndarray:
    """Mean modes over trials with added noise; the rest row is set so that rows add up to y."""
    return eemd_many([y], trials, noise, seed, most)[0]


def _with_modes(bars: DataFrame, column: str, most: int, schema: str, emit: Callable[..., pa.RecordBatch]) -> DataFrame:
    """emit(tables, modes) for some symbols at a time: their tables of dt and column by dt, and their modes over 50 trials."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            series = [t[column].cast(pa.float64()).to_numpy() for t in tables]
            yield emit(tables, eemd_many(series, trials=50, most=most))

        def symbols() -> Iterator[pa.Table]:
            held: list[pa.Table] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                t = pa.Table.from_batches([batch])
                code = batch.column("symbol").dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)  # null is a symbol too
                starts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist()]
                for i, j in zip(starts, [*starts[1:], batch.num_rows]):
                    part = t.slice(i, j - i)
                    if held and held[0]["symbol"][0] != part["symbol"][0]:
                        yield pa.concat_tables(held)
                        held = []
                    held.append(part)
            if held:
                yield pa.concat_tables(held)

        ready: list[pa.Table] = []
        for table in symbols():
            ready.append(table)
            if sum(t.num_rows for t in ready) > 6000:
                yield from work(ready)
                ready = []
        if ready:
            yield from work(ready)

    return bars.select("symbol", "dt", column).repartition("symbol").sortWithinPartitions("symbol", "dt").mapInArrow(run, schema)


def modes_frame(bars: DataFrame, column: str = "close", most: int = 4) -> DataFrame:
    """symbol, dt, mode, value in long form: the first modes of each symbol and the rest as mode 0."""

    def emit(tables: list[pa.Table], modes: list[np.ndarray]) -> pa.RecordBatch:
        found = np.concatenate(modes, axis=1)
        both = pa.concat_tables(tables).select(["symbol", "dt"]).combine_chunks()
        new = [pa.array(found[k - 1], from_pandas=True) for k in range(most + 1)]  # NaN becomes null
        return pa.RecordBatch.from_arrays([*[both[c].combine_chunks() for c in ("symbol", "dt")], *new], ["symbol", "dt", *[f"m{k}" for k in range(most + 1)]])

    kind = {f.name: f.dataType.simpleString() for f in bars.schema}
    wide = _with_modes(bars, column, most, ", ".join([f"symbol {kind['symbol']}, dt {kind['dt']}", *[f"m{k} double" for k in range(most + 1)]]), emit)
    pairs = F.array(*[F.struct(F.lit(k).alias("mode"), F.col(f"m{k}").alias("value")) for k in range(most + 1)])
    return wide.select("symbol", "dt", F.explode(pairs).alias("p")).select("symbol", "dt", "p.mode", "p.value")


def mode_turns(modes: DataFrame) -> DataFrame:
    """modes(symbol, dt, mode, value) -> symbol, mode, turns (changes of sign), power (deviation) of all modes but the rest."""
    w = Window.partitionBy("symbol", "mode").orderBy("dt")
    turn = modes.where("mode > 0").withColumn("turn", (F.signum("value") != F.signum(F.lag("value").over(w))).cast("int"))
    return turn.groupBy("symbol", "mode").agg(F.sum("turn").alias("turns"), F.stddev_pop("value").alias("power"))


def bar_mode_turns(bars: DataFrame, column: str = "close", most: int = 4) -> DataFrame:
    """mode_turns(modes_frame(...)), counted where the modes are made, so that only a row for each symbol and mode is left."""

    def emit(tables: list[pa.Table], modes: list[np.ndarray]) -> pa.RecordBatch:
        symbol = pa.concat_arrays([t["symbol"].combine_chunks()[:1] for t in tables for _ in range(most)])
        turns = [int(np.count_nonzero(np.diff(np.sign(v)))) if len(v) > 1 else None for m in modes for v in m[:most]]
        power = [float(np.std(v)) for m in modes for v in m[:most]]
        mode = pa.array(list(range(1, most + 1)) * len(tables), pa.int32())
        return pa.RecordBatch.from_arrays([symbol, mode, pa.array(turns, pa.int64()), pa.array(power)], ["symbol", "mode", "turns", "power"])

    return _with_modes(bars, column, most, f"symbol {bars.schema['symbol'].dataType.simpleString()}, mode int, turns long, power double", emit)


def best_turns(turns: DataFrame, top: int = 4) -> DataFrame:
    """Of mode_turns, per symbol the modes whose sign changes least often among those that change at all, at most `top`."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("turns", F.col("power").desc(), "mode"))
    return turns.where("turns > 0").withColumn("rank", rank).where(F.col("rank") <= top)


def best_modes(modes: DataFrame, top: int = 4) -> DataFrame:
    return best_turns(mode_turns(modes), top)


def circle(points: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Algebraic least-squares circle of each group, from sums only: cx, cy, radius."""
    m = points.groupBy(by).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    p = points.join(m, by).select(by, "mx", "my", (F.col(x) - F.col("mx")).alias("u"), (F.col(y) - F.col("my")).alias("v"))
    u, v = F.col("u"), F.col("v")
    z = u * u + v * v
    s = p.groupBy(by).agg(
        F.first("mx").alias("mx"), F.first("my").alias("my"), F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"),
        F.sum(u * z).alias("uz"), F.sum(v * z).alias("vz"), F.count("*").alias("n"),
    )
    det = F.nullif(F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv"), F.lit(0.0)) * 2
    a = (F.col("uz") * F.col("vv") - F.col("vz") * F.col("uv")) / det
    b = (F.col("vz") * F.col("uu") - F.col("uz") * F.col("uv")) / det
    radius = F.sqrt(a * a + b * b + (F.col("uu") + F.col("vv")) / F.col("n"))
    return s.select(by, (a + F.col("mx")).alias("cx"), (b + F.col("my")).alias("cy"), radius.alias("radius"))


def clusters(features: DataFrame, columns: list[str], k: int = 4, seed: int = 7) -> DataFrame:
    """Gaussian mixture over standardised columns of all rows; adds cluster. Rows with nulls go."""
    df = features.dropna(subset=columns)
    stats = df.agg(*[F.avg(c).alias(f"a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    scaled = df.withColumns({f"__std_{c}": (F.col(c) - stats[f"a_{c}"]) / (stats[f"s_{c}"] or 1.0) for c in columns})
    table = VectorAssembler(inputCols=[f"__std_{c}" for c in columns], outputCol="__vector").transform(scaled)
    model = GaussianMixture(k=k, seed=seed, featuresCol="__vector", predictionCol="cluster", probabilityCol="__p", maxIter=20).fit(table)
    return model.transform(table).drop("__vector", "__p", *[f"__std_{c}" for c in columns])


def slices(labelled: DataFrame, label: str, margin: int = 36) -> DataFrame:
    """Wave slices where the label changes; a slice shorter than margin joins the one before. Needs rn."""
    new = F.coalesce((F.col(label) != F.lag(label).over(W.w())).cast("int"), F.lit(1))
    df = labelled.withColumn("__s", F.sum(new).over(W.upto()))
    size = Window.partitionBy("symbol", "__s")
    long = F.count("*").over(size) >= margin
    df = df.withColumn("__long", long)
    return df.withColumn("slice", F.coalesce(F.last(F.when(F.col("__long"), F.col("__s")), True).over(W.upto()), F.lit(0))).drop("__s", "__long")
