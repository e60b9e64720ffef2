"""Window primitives on (symbol, dt): each adds columns and keeps one exchange on symbol.

Functions take and return a DataFrame that has a row number `rn` in its symbol (see numbered), so that steps which need
two window passes stay in the same partitioning and sort order. Warm-up rows are null, never NaN.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY, TIME = "symbol", "dt"


def w() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(TIME)


def upto() -> WindowSpec:
    return w().rowsBetween(Window.unboundedPreceding, 0)


def frame(n: int) -> WindowSpec:
    return w().rowsBetween(-(n - 1), 0)


def whole() -> WindowSpec:
    return Window.partitionBy(KEY)


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(w()).cast("bigint"))


def lag(c: str | Column, k: int = 1) -> Column:
    return (F.lag(c, k) if k >= 0 else F.lead(c, -k)).over(w())


def delta(c: str, k: int = 1) -> Column:
    return F.col(c) - lag(c, k)


def pct_change(c: str, k: int = 1) -> Column:
    return F.col(c) / lag(c, k) - 1


def log_return(c: str, k: int = 1) -> Column:
    return F.ln(F.col(c) / lag(c, k))


def full(value: Column, n: int) -> Column:
    """Null until n rows are there."""
    return F.when(F.col("rn") >= n, value)


def rolling(agg: Callable[..., Column], c: str | Column, n: int, partial: bool = False) -> Column:
    value = agg(c).over(frame(n))
    return value if partial else full(value, n)


def sma(c: str | Column, n: int, partial: bool = False) -> Column:
    return rolling(F.avg, c, n, partial)


def rolling_quantile(c: str, p: float, n: int) -> Column:
    return full(F.percentile(F.col(c), F.lit(p)).over(frame(n)), n)


def pct_rank(c: str, n: int) -> Column:
    """Share of the window that is at most the last value; ties count."""
    held = F.collect_list(c).over(frame(n))
    return full(F.size(F.filter(held, lambda v: v <= F.col(c))) / F.lit(n), n)


def zscore(df: DataFrame, c: str, n: int, out: str) -> DataFrame:
    """z-score of the last value in n rows, population sigma; symbols with n rows or fewer: over the whole symbol."""
    stats = {"__n": F.count("*").over(whole()), "__ma": F.avg(c).over(whole()), "__sa": F.stddev_pop(c).over(whole())}
    df = df.withColumns(stats | {"__m": F.avg(c).over(frame(n)), "__s": F.stddev_pop(c).over(frame(n))})
    own = full((F.col(c) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0)), n)
    every = (F.col(c) - F.col("__ma")) / F.nullif(F.col("__sa"), F.lit(0.0))
    return df.withColumn(out, F.when(F.col("__n") <= n, every).otherwise(own)).drop("__n", "__ma", "__sa", "__m", "__s")


def ols_slope(c: str, n: int) -> Column:
    return full(F.regr_slope(F.col(c), F.col("rn")).over(frame(n)), n)


def ols_end(c: str, n: int) -> Column:
    """Value of the regression line at the last row."""
    f = frame(n)
    return full(F.regr_intercept(F.col(c), F.col("rn")).over(f) + F.regr_slope(F.col(c), F.col("rn")).over(f) * F.col("rn"), n)


def euclidean(a: str, b: str, n: int) -> Column:
    """Distance of two columns over the n rows before; 0 for the first n rows."""
    d = F.sqrt(F.sum(F.pow(F.col(a) - F.col(b), 2)).over(w().rowsBetween(-n, -1)))
    return F.when(F.col("rn") > n, d).otherwise(0.0)


def wma(df: DataFrame, c: str, n: int, out: str, after: int = 0) -> DataFrame:
    """Linearly weighted mean of n rows; after: warm-up rows that c itself has."""
    s = F.sum(F.col(c)).over(frame(n))
    sj = F.sum(F.col(c) * F.col("rn")).over(frame(n))
    return df.withColumn(out, full((sj - (F.col("rn") - n) * s) / (n * (n + 1) / 2), n + after))


def hma(df: DataFrame, c: str, n: int, out: str) -> DataFrame:
    """Hull mean: wma of 2*wma(n/2) - wma(n) over round(sqrt(n))."""
    df = wma(wma(df, c, n // 2, "__half"), c, n, "__full")
    df = df.withColumn("__raw", 2 * F.col("__half") - F.col("__full"))
    return wma(df, "__raw", int(n**0.5 + 0.5), out, n - 1).drop("__half", "__full", "__raw")


def last_at(event: Column, value: Column | str) -> Column:
    """Value at the last row with event, carried forward."""
    return F.last(F.when(event, F.col(value) if isinstance(value, str) else value), True).over(upto())


def back_fill(c: str) -> Column:
    return F.first(F.col(c), True).over(w().rowsBetween(0, Window.unboundedFollowing))


def bars_since(event: Column) -> Column:
    """0 at an event, then 1, 2, ...; before the first event 1, 2, ... from the first row."""
    return F.col("rn") - F.coalesce(last_at(F.coalesce(event, F.lit(False)), "rn"), F.lit(0).cast("bigint"))


def run_length(flag: Column) -> Column:
    """Rows in the current run of a true flag; null counts as false."""
    return bars_since(~F.coalesce(flag, F.lit(False)))


def signed_run(signal: Column) -> Column:
    return run_length(signal > 0) - run_length(signal < 0)


def crossed(a: str, b: str) -> Column:
    """a comes from at most b to above b."""
    return F.coalesce((F.col(a) > F.col(b)) & (lag(a) <= lag(b)), F.lit(False))


def ranked(df: DataFrame, c: str, out: str) -> DataFrame:
    """Cross-section by dt: descending rank with ties averaged, and rank / count."""
    day = Window.partitionBy(TIME)
    ties = Window.partitionBy(TIME, c)
    rank = F.rank().over(day.orderBy(F.col(c).desc())) + (F.count("*").over(ties) - 1) / 2.0
    df = df.withColumn(f"{out}_rank", rank)
    return df.withColumn(f"{out}_pct", F.col(f"{out}_rank") / F.count("*").over(day))
