"""Aggregations, joins, set operations and screens over bar and feature tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Inner and outer limits of tables that are small by nature and may be broadcast after a look at their size.
BROADCAST_ROWS = 100_000
#: Groups of symbols at most for covariances, and symbols of a tile of the matrix.
GROUPS, TILE = 24, 1000

# Measures of market breadth, by how they aggregate.
BREADTH_SUM = (
    "FLU_POSITIVE", "ML_FLU_TREND", "VOLUME_FLOW_BOOST", "CLUSTER_GROUP_TOWARDS", "ATR_Stopline", "ATR_SuperTrend",
    "MAXFACTOR_CROSS", "DUAL_CROSS", "TALIB_PATTERNS", "ADXm_Trend", "Volume_HMA5", "RENKO_TREND_S", "RENKO_TREND_L",
)
BREADTH_TRUE = ("BOOTSTRAP_I", "DEADPOOL", "FLU_POSITIVE_MASTER", "FLU_NEGATIVE_MASTER", "VOLUME_FLOW_BOOST_BONUS")
BREADTH_SIGN = ("BOLL_RENKO", "BOOTSTRAP_GROUND_ZERO", "BOLL_RENKO_MINOR", "BOOTSTRAP_GROUND_ZERO_MINOR")
BREADTH_AVG = {"PEAK_OPEN": "PEAK_OPEN", "PEAK_OPEN_MINOR": "PEAK_OPEN_MINOR", "DEA_NORM": "DEA", "MACD_NORM": "MACD", "MACD_DELTA_NORM": "MACD_DELTA"}


def breadth(features: DataFrame, by: Sequence[str] = ("dt",)) -> DataFrame:
    """One row for each date (and block, frequency): sums, counts of true rows, sign votes and means of the columns
    that features has, and the number of symbols. A missing vote counts as not at least 0."""
    has = set(features.columns)
    aggs = [F.sum(c).alias(c) for c in BREADTH_SUM if c in has]
    aggs += [F.sum(F.when(F.coalesce(F.col(c), F.lit(0)) != 0, 1).otherwise(0)).alias(c) for c in BREADTH_TRUE if c in has]
    aggs += [F.sum(F.when(F.coalesce(F.col(c) >= 0, F.lit(False)), 1).otherwise(-1)).alias(c) for c in BREADTH_SIGN if c in has]
    aggs += [F.avg(c).alias(new) for c, new in BREADTH_AVG.items() if c in has]
    return features.groupBy(*by).agg(*aggs, F.count("*").alias("total"))


def price_by_volume(bars: DataFrame, step: float) -> DataFrame:
    """Volume at price: closes to the nearest multiple of step, halves to even."""
    level = F.bround(F.col("close") / step, 0) * step
    return bars.groupBy("symbol", level.alias("level")).agg(F.sum("volume").alias("volume"))


def winsor_quantile(df: DataFrame, c: str, low: float = 0.025, high: float = 0.975, by: Sequence[str] = ("symbol",)) -> DataFrame:
    q = Window.partitionBy(*by)
    a, b = (F.percentile(F.col(c), F.lit(p)).over(q) for p in (low, high))
    return df.withColumn(c, F.least(F.greatest(F.col(c), a), b))


def _all_small(c: str, q) -> Column:
    return F.max(F.abs(F.col(c))).over(q) <= 1


def winsor_mad(df: DataFrame, c: str, k: float = 3 * 1.4826, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Clamp to median +- k MAD; columns within [-1, 1] stay."""
    q = Window.partitionBy(*by)
    df = df.withColumn("__m", F.median(c).over(q)).withColumn("__d", F.abs(F.col(c) - F.col("__m")))
    df = df.withColumn("__mad", F.median("__d").over(q) * k).withColumn("__small", _all_small(c, q))
    clamped = F.least(F.greatest(F.col(c), F.col("__m") - F.col("__mad")), F.col("__m") + F.col("__mad"))
    return df.withColumn(c, F.when(F.col("__small"), F.col(c)).otherwise(clamped)).drop("__m", "__d", "__mad", "__small")


def winsor_sigma(df: DataFrame, c: str, k: float = 3.0, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Clamp to mean +- k sample sigma; columns within [-1, 1] stay."""
    q = Window.partitionBy(*by)
    m, s = F.avg(c).over(q), F.stddev_samp(c).over(q)
    clamped = F.least(F.greatest(F.col(c), m - k * s), m + k * s)
    return df.withColumn(c, F.when(_all_small(c, q), F.col(c)).otherwise(clamped))


def standardized(df: DataFrame, c: str, out: str, kind: int, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """1: min-max, 2: z with sample sigma, 3: decimal scaling. Null rows go."""
    q = Window.partitionBy(*by)
    x = F.col(c)
    if kind == 1:
        lo, hi = F.min(x).over(q), F.max(x).over(q)
        value = (x - lo) / F.nullif(hi - lo, F.lit(0.0))
    elif kind == 2:
        value = (x - F.avg(x).over(q)) / F.nullif(F.stddev_samp(x).over(q), F.lit(0.0))
    elif kind == 3:
        value = x / F.pow(F.lit(10.0), F.ceil(F.log10(F.max(F.abs(x)).over(q))))
    else:
        raise ValueError(f"kind {kind}")
    return df.where(x.isNotNull()).withColumn(out, value)


def column_zscore(df: DataFrame, c: str, out: str, by: Sequence[str] = ("symbol",)) -> DataFrame:
    q = Window.partitionBy(*by)
    return df.withColumn(out, (F.col(c) - F.avg(c).over(q)) / F.nullif(F.stddev_pop(c).over(q), F.lit(0.0)))


def one_each(spark: SparkSession, count: int) -> list[int]:
    """Integers that hash partitioning deals to the partitions 0, 1, ... of so many, one to each."""
    k = F.col("id").cast("int")
    found = spark.range(0, 60 * count, 1, 1).select(k.alias("k"), F.pmod(F.hash(k), F.lit(count)).alias("at")).collect()
    first = {r["at"]: r["k"] for r in reversed(found)}
    return [first[x] for x in range(count)]


class _Side:
    """A group's packed returns: symbols, and by tiles of them their observations in the order of dates."""

    def __init__(self, packed: pa.StructArray, day: np.ndarray) -> None:
        self.symbols = packed.field("symbol").to_pylist()
        self.ends = packed.field("t").offsets.to_numpy()
        self.ends = self.ends - self.ends[0]
        self.day, self.ret = day, packed.field("ret").flatten().to_numpy()

    def tile(self, first: int, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, days, their places, returns) of the tile."""
        ends = self.ends[first : first + size + 1]
        day, ret = self.day[ends[0] : ends[-1]], self.ret[ends[0] : ends[-1]]
        place = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        order = np.argsort(day, kind="stable")
        return len(ends) - 1, day[order], place[order], ret[order]


def _dense(tile: tuple[int, np.ndarray, np.ndarray, np.ndarray], first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(returns, whether they are there) of the days from first to last by symbol, 0 where there is none."""
    count, day, place, ret = tile
    some = slice(*np.searchsorted(day, (first, last)))
    x, there = np.zeros((last - first, count)), np.zeros((last - first, count), np.float32)
    x[day[some] - first, place[some]] = ret[some]
    there[day[some] - first, place[some]] = 1
    return x, there


def _covariances(a: tuple, b: tuple, days: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """(covariance, common dates) of two tiles; NaN below two dates."""
    ab, xa, xb = (np.zeros((a[0], b[0])) for _ in range(3))
    n = np.zeros((a[0], b[0]))
    for first in range(0, days, 512):
        last = min(first + 512, days)
        x, in_x = _dense(a, first, last)
        y, in_y = (x, in_x) if same else _dense(b, first, last)
        ab += x.T @ y
        xa += x.T @ in_y.astype(float)
        if not same:
            xb += in_x.T.astype(float) @ y
        n += in_x.T @ in_y
    with np.errstate(divide="ignore", invalid="ignore"):
        ab -= xa * (xa.T if same else xb) / n
        ab /= n - 1
    ab[n < 2] = np.nan
    return ab, n


def packed_returns(returns: DataFrame) -> DataFrame:
    """returns(dt, symbol, ret) -> symbol, mean, t, ret: one row for each symbol with arrays of its times and of its returns less
    their mean, so that sums of what is about zero lose no digits."""
    mean = F.avg("ret").over(Window.partitionBy("symbol"))
    rows = returns.where("ret is not null and dt is not null and symbol is not null").select("symbol", F.unix_micros(F.col("dt").cast("timestamp")).alias("t"), F.col("ret").cast("double").alias("ret"))
    rows = rows.withColumn("mean", mean).withColumn("ret", F.col("ret") - F.col("mean"))
    packed = rows.groupBy("symbol").agg(F.first("mean").alias("mean"), F.collect_list(F.struct("t", "ret")).alias("p"))
    return packed.select("symbol", "mean", F.col("p.t").alias("t"), F.col("p.ret").alias("ret"))


def cross_covariance(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Covariances of the packed returns (t, ret) of symbols, 0 for a pair with fewer than two common dates."""
    out = np.empty((len(a), len(b)))

    def cut(rows: list, day: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(day, kind="stable")
        place = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
        return len(rows), day[order], place[order], np.concatenate([r for _, r in rows])[order]

    for x in range(0, len(a), TILE):
        for y in range(0, len(b), TILE):
            p, q = a[x : x + TILE], b[y : y + TILE]
            days, day = np.unique(np.concatenate([t for t, _ in p + q]), return_inverse=True)
            split = sum(len(t) for t, _ in p)
            cov, _ = _covariances(cut(p, day[:split]), cut(q, day[split:]), len(days), False)
            out[x : x + TILE, y : y + TILE] = np.nan_to_num(cov, posinf=np.inf, neginf=-np.inf)
    return out


def _blocks(returns: DataFrame, schema: str, emit: Callable[..., Iterator[pa.RecordBatch]], tile: int) -> DataFrame:
    """Covariances of returns(dt, symbol, ret), tile by tile: emit(a, b, cov, n, same) makes rows of two tiles' symbols, the
    covariance by n common dates (NaN below 2) and whether both are the same tile. Symbols are dealt to groups by hash; a task
    reads two groups where the one shuffle left them, so nothing is copied for the pairs, and holds the sums of one pair of
    tiles."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                i, j = (batch.column(c)[k].as_py() for c in ("i", "j"))
                p, q = (batch.column(c)[k].values for c in ("a", "b"))
                times = [x.field("t").flatten().to_numpy() for x in (p, q)]
                days, day = np.unique(np.concatenate(times), return_inverse=True)
                a, b = _Side(p, day[: len(times[0])]), _Side(q, day[len(times[0]) :])
                for x in range(0, len(a.symbols), tile):
                    one = a.tile(x, tile)
                    for y in range(x if i == j else 0, len(b.symbols), tile):
                        same = i == j and x == y
                        cov, n = _covariances(one, one if same else b.tile(y, tile), len(days), same)
                        yield from emit(a.symbols[x : x + tile], b.symbols[y : y + tile], cov, n, same)

    spark = returns.sparkSession
    count = min(GROUPS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    group = F.pmod(F.xxhash64("symbol", F.lit(7)), F.lit(count)).cast("int")
    key = F.element_at(F.array(*map(F.lit, one_each(spark, count))), group + 1)
    dealt = packed_returns(returns).select(key.alias("key"), group.alias("group"), F.struct("symbol", "t", "ret").alias("p"))
    held = dealt.repartition(count, "key").groupBy("key").agg(F.first("group").alias("group"), F.collect_list("p").alias("p"))
    left, right = held.select(F.col("group").alias("i"), F.col("p").alias("a")), held.select(F.col("group").alias("j"), F.col("p").alias("b"))
    pairs = left.join(right.hint("shuffle_replicate_nl"), F.col("i") <= F.col("j"))
    return pairs.mapInArrow(products, schema)


def covariance(returns: DataFrame, tile: int = TILE) -> DataFrame:
    """returns(dt, symbol, ret) -> a, b, cov, n of all symbol pairs with a <= b that have a date in common; cov is null for one
    date."""
    kind = returns.schema["symbol"].dataType

    def pairs(a: list, b: list, cov: np.ndarray, n: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        order = {x: k for k, x in enumerate(sorted({*a, *b}))}
        names = pa.array(list(order), to_arrow_type(kind))
        p, q = (np.array([order[x] for x in side]) for side in (a, b))
        for k in range(0, len(a), 64):
            x, y = p[k : k + 64, None], q[None, :]
            there = (n[k : k + 64] > 0) & (x <= y if same else True)
            value = pa.array(cov[k : k + 64][there], from_pandas=True)  # NaN becomes null
            ends = [names.take(pa.array(f(x, y)[there])) for f in (np.minimum, np.maximum)]
            yield pa.RecordBatch.from_arrays([*ends, value, pa.array(n[k : k + 64][there].astype(np.int64))], ["a", "b", "cov", "n"])

    return _blocks(returns, f"a {kind.simpleString()}, b {kind.simpleString()}, cov double, n long", pairs, tile)


def covariance_blocks(returns: DataFrame, tile: int = TILE) -> DataFrame:
    """covariance as pieces of the matrix: arrays a and b of symbols and the bytes of their doubles, row by row; NaN below two
    common dates. Of two symbols, one order or both are there."""
    kind = returns.schema["symbol"].dataType

    def pieces(a: list, b: list, cov: np.ndarray, n: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        arrow = pa.list_(to_arrow_type(kind))
        for k in range(0, len(a), 250):
            yield pa.RecordBatch.from_arrays([pa.array([a[k : k + 250]], arrow), pa.array([b], arrow), pa.array([np.ascontiguousarray(cov[k : k + 250]).tobytes()], pa.binary())], ["a", "b", "cov"])

    return _blocks(returns, f"a array<{kind.simpleString()}>, b array<{kind.simpleString()}>, cov binary", pieces, tile)


def expected_shortfall(returns: DataFrame, bars: int = 252, share: float = 0.02) -> DataFrame:
    """Per symbol the mean of the worst share of the last bars returns, as a loss; and the parametric VaR."""
    newest = Window.partitionBy("symbol").orderBy(F.col("dt").desc())
    df = returns.where("ret is not null").withColumn("__age", F.row_number().over(newest)).where(F.col("__age") <= bars)
    worst = Window.partitionBy("symbol").orderBy("ret", "dt")
    df = df.withColumn("__k", F.row_number().over(worst) - 1).withColumn("__n", F.count("*").over(Window.partitionBy("symbol")))
    tail = F.sum(F.when(F.col("__k") < F.col("__n") * share, F.col("ret")).otherwise(0.0))
    return df.groupBy("symbol").agg(
        (-tail / (F.first("__n") * share)).alias("es"), (F.stddev_samp("ret") * share * 100).alias("var"), F.first("__n").alias("n")
    )


def asof(left: DataFrame, right: DataFrame, columns: Sequence[str], key: str = "symbol", time: str = "dt") -> DataFrame:
    """Latest row of right strictly before each row of left: one union and one window on the key, no range join."""
    width = [F.col(c) for c in columns]
    low = right.select(key, time, F.struct(*width).alias("__v"), F.lit(1).alias("__side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (key, time)])
    high = left.withColumn("__v", F.lit(None).cast(low.schema["__v"].dataType)).withColumn("__side", F.lit(0))
    w = Window.partitionBy(key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = high.unionByName(low).withColumn("__v", F.last("__v", True).over(w)).where("__side = 0")
    return both.select(*left.columns, *[F.col(f"__v.{c}").alias(c) for c in columns])


def densified(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Every symbol on every date: values carried forward, then back. The distinct dates are one array, bounded by the
    calendar, that every symbol's row unfolds, so the result has symbols times dates rows by definition."""
    dates = df.agg(F.sort_array(F.collect_set("dt")).alias("__dates"))  # one row: the calendar
    grid = df.select("symbol").distinct().join(F.broadcast(dates)).select("symbol", F.explode("__dates").alias("dt"))
    full = grid.join(df, ["symbol", "dt"], "left")
    w = Window.partitionBy("symbol").orderBy("dt")
    fwd, back = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return full.withColumns({c: F.coalesce(F.last(c, True).over(fwd), F.first(c, True).over(back)) for c in values})


def screen(df: DataFrame, predicate: str, label: str | None = None, tag: str = "tags") -> tuple[DataFrame, DataFrame]:
    """(matched, rest) of a SQL predicate; null counts as no match. Matched rows get label before their tags."""
    hit = F.coalesce(F.expr(predicate), F.lit(False))
    matched = df.where(hit)
    if label is not None:
        old = F.coalesce(F.col(tag), F.lit("")) if tag in df.columns else F.lit("")
        matched = matched.withColumn(tag, F.concat(F.lit(f"{label},"), old))
    return matched, df.where(~hit)


def named(df: DataFrame, names: DataFrame, code: str = "symbol", name: str = "name") -> DataFrame:
    """Adds the display name of a code, the code itself where there is none."""
    joined = df.join(names.select(F.col(code).alias("__c"), F.col(name).alias("__n")), F.col(code) == F.col("__c"), "left")
    return joined.withColumn(name, F.coalesce("__n", F.col(code).cast("string"))).drop("__c", "__n")


def last_match_wins(rules: Sequence[tuple[int, Column]], default: Column | None = None) -> Column:
    """Overwrite cascade: of all rules that hold the last one gives the value."""
    out = None
    for value, condition in reversed(rules):
        out = F.when(condition, value) if out is None else out.when(condition, value)
    if out is None:
        raise ValueError("no rules")
    return out.otherwise(F.lit(0) if default is None else default)


def month_end(calendar: DataFrame, dt: str = "dt") -> DataFrame:
    """Adds is_month_end: the next trading day is in another month; 0 for the last row."""
    nxt = F.lead(dt).over(Window.orderBy(dt))  # one row for each trading day
    return calendar.withColumn("is_month_end", F.coalesce((F.month(dt) != F.month(nxt)).cast("bigint"), F.lit(0).cast("bigint")))


def walk_back(calendar: DataFrame, days: DataFrame, most: int = 10) -> DataFrame:
    """days(day) -> day, dt: the latest trading day at most `most` calendar days back."""
    c = calendar.select(F.col("dt").alias("__dt"))
    near = days.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("__dt", F.expr("day - make_interval(0, 0, 0, __k)"))
    return near.join(c, "__dt").groupBy("day").agg(F.max("__dt").alias("dt"))


def _latest(df: DataFrame, bars: int) -> DataFrame:
    newest = Window.partitionBy("symbol").orderBy(F.col("dt").desc())
    return df.withColumn("__back", F.row_number().over(newest)).where(F.col("__back") <= bars).drop("__back")


def last_correlation(df: DataFrame, a: str, b: str, bars: int) -> DataFrame:
    """Per symbol the correlation of two columns over the last bars, null where one doesn't vary: symbol, corr."""
    spread = F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
    return _latest(df, bars).groupBy("symbol").agg((F.covar_pop(a, b) / spread).alias("corr"))


def mean_moves(returns: DataFrame, bars: int = 120) -> DataFrame:
    """Per symbol the mean absolute return and the mean amount of the last bars: symbol, move, turnover."""
    return _latest(returns, bars).groupBy("symbol").agg(F.avg(F.abs("ret")).alias("move"), F.avg("amount").alias("turnover"))
