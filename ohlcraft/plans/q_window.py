"""Queries of bars, window primitives and window-only indicators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import window as W
from ..sources.bars import day_bars
from .oracle import P, UPTO, full, over, run, since, sma, with_bars
from .oracle import W as OW

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.numbered(day_bars(spark, sf_dir))


def r(c: Column, k: int = 4) -> Column:
    """Rounded for comparison; the offset far below the last place makes exact ties and negative zero round alike in any engine."""
    return F.round(c + F.lit(10.0 ** -(k + 3)), k)


def R(s: str, k: int = 4) -> str:
    """r() as SQL."""
    return f"(round({s} + 1e-{k + 3}::DOUBLE, {k}) + 0::DOUBLE)"


def simple(name: str, columns: dict[str, tuple[Callable[[], Column], str]], sql: str = " SELECT symbol, dt, {} FROM b") -> None:
    """A query of columns over numbered bars with its SQL: name -> (maker of the column, SQL expression)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return numbered(spark, sf_dir).select("symbol", "dt", *[c().alias(k) for k, (c, _) in columns.items()])

    QUERIES[name] = query
    ORACLES[name] = with_bars(sql.format(", ".join(f"{s} AS {k}" for k, (_, s) in columns.items())))


def build() -> None:
    q: Callable[[str], Column] = F.col
    lag = lambda c, k=1: f"lag({c}, {k}) {OW}" if k > 0 else f"lead({c}, {-k}) {OW}"
    simple(
        "bars_day",
        {c: (lambda c=c: r(q(c)), R(c)) for c in ("open", "high", "low", "close", "volume", "amount")},
    )
    simple(
        "kline_returns",
        {
            "pct_1": (lambda: r(W.pct_change("close"), 6), R(f"close / {lag('close')} - 1", 6)),
            "log_1": (lambda: r(W.log_return("close"), 6), R(f"ln(close / {lag('close')})", 6)),
            "log_5": (lambda: r(W.log_return("close", 5), 6), R(f"ln(close / {lag('close', 5)})", 6)),
        },
    )
    simple("momentum_24", {"momentum": (lambda: r(W.pct_change("close", 24) - 0.02, 6), R(f"close / {lag('close', 24)} - 1 - 0.02::DOUBLE", 6))})
    stats = [("avg", F.avg), ("max", F.max), ("min", F.min), ("stddev_samp", F.stddev_samp), ("var_samp", F.var_samp)]
    columns = {f"{n}_20": (lambda f=f, n=n: r(W.rolling(f, "close", 20), 1 if n == "var_samp" else 4), R(full(f"{n}(close) {over(20)}", 20), 1 if n == "var_samp" else 4)) for n, f in stats}
    columns["median_20"] = (lambda: r(W.rolling_quantile("close", 0.5, 20)), R(full(f"median(close) {over(20)}", 20)))
    simple("rolling_features_20", columns)
    columns = {f"lag_{k}": (lambda k=k: r(W.lag("close", k)), R(lag("close", k))) for k in (1, 2, 3, 5, 8)}
    columns["lead_1"] = (lambda: r(W.lag("close", -1)), R(lag("close", -1)))
    columns |= {f"diff_{k}": (lambda k=k: r(W.delta("close", k)), R(f"close - {lag('close', k)}")) for k in (1, 2, 5)}
    simple("lag_diff_features", columns)
    simple("second_diff", {"d2": (lambda: r(q("close") - 2 * W.lag("close") + W.lag("close", 2)), R(f"close - 2 * {lag('close')} + {lag('close', 2)}"))})
    simple("rolling_sum_10", {"s": (lambda: r(W.rolling(F.sum, "volume", 10)), R(full(f"sum(volume) {over(10)}", 10)))})
    simple("rolling_euclid_5", {"d": (lambda: r(W.euclidean("open", "close", 5)), R(
        "CASE WHEN rn > 5 THEN sqrt(sum(pow(open - close, 2)) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) ELSE 0.0::DOUBLE END"))})
    simple("rolling_quantile_84", {f"q{int(p * 1000)}": (lambda p=p: r(W.rolling_quantile("close", p, 84)), R(full(f"quantile_cont(close, {p}) {over(84)}", 84))) for p in (0.618, 0.75)})
    simple("pct_rank_21", {"pr": (lambda: r(W.pct_rank("close", 21), 6), R(full(f"len(list_filter(list(close) {over(21)}, lambda v: v <= close)) / 21", 21), 6))})
    simple("ols_slope_14", {"slope": (lambda: r(W.ols_slope("close", 14)), R(full(f"regr_slope(close, rn) {over(14)}", 14)))})
    simple("linreg_end_20", {"line": (lambda: r(W.ols_end("close", 20), 3), R(full(f"regr_intercept(close, rn) {over(20)} + regr_slope(close, rn) {over(20)} * rn", 20), 3))})
    up = lambda: q("close") > q("open")
    sup = "close > open"
    simple("bars_since_up", {"since": (lambda: W.bars_since(up()), since(sup))})
    simple("run_length_up", {"run": (lambda: W.run_length(up()), run(sup))})
    sign = lambda: F.signum(q("close") - q("open"))
    simple("signed_run_up", {"run": (lambda: W.signed_run(sign()), f"{run(sup)} - ({run('close < open')})")})
    simple("last_at_event", {
        "close_at": (lambda: r(W.last_at(up(), "close")), R(f"last_value(CASE WHEN {sup} THEN close END IGNORE NULLS) {UPTO}")),
        "close_next": (lambda: r(F.first(F.when(up(), q("close")), True).over(W.w().rowsBetween(0, 2**31 - 1))), R(f"first_value(CASE WHEN {sup} THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")),
    })
    simple("local_extrema", {"mark": (
        lambda: F.when((q("close") < W.lag("close")) & (q("close") < W.lag("close", -1)), 1).when((q("close") > W.lag("close")) & (q("close") > W.lag("close", -1)), -1).otherwise(0).cast("bigint"),
        f"CASE WHEN close < {lag('close')} AND close < {lag('close', -1)} THEN 1 WHEN close > {lag('close')} AND close > {lag('close', -1)} THEN -1 ELSE 0 END::BIGINT")})
    simple("bias_10_20_30", {f"bias_{n}": (lambda n=n: r(100 * (q("close") - W.sma("close", n)) / W.sma("close", n)), R(f"100 * (close - {sma('close', n)}) / {sma('close', n)}")) for n in (10, 20, 30)})
    mid = lambda: W.sma("close", 20)
    sd = lambda: W.rolling(F.stddev_pop, "close", 20)
    smid, ssd = sma("close", 20), full(f"stddev_pop(close) {over(20)}", 20)
    simple("bollinger_20", {
        "mid": (lambda: r(mid()), R(smid)), "ub": (lambda: r(mid() + 2 * sd()), R(f"{smid} + 2 * {ssd}")), "lb": (lambda: r(mid() - 2 * sd()), R(f"{smid} - 2 * {ssd}")),
        "width": (lambda: r(4 * sd() / mid()), R(f"4 * {ssd} / {smid}")), "clearance": (lambda: r((mid() + 2 * sd() - q("close")) / mid()), R(f"({smid} + 2 * {ssd} - close) / {smid}")),
    })
    simple("forward_nbar", {
        "income_5": (lambda: r(W.lag("close", -5) / q("close") - 1, 2), R(f"{lag('close', -5)} / close - 1", 2)),
        "percentile_5": (lambda: r(F.when(W.lag("close", -5).isNotNull(), F.when(F.max("high").over(W.w().rowsBetween(1, 5)) == F.min("low").over(W.w().rowsBetween(1, 5)), 0.0).otherwise(
            (q("close") - F.min("low").over(W.w().rowsBetween(1, 5))) / (F.max("high").over(W.w().rowsBetween(1, 5)) - F.min("low").over(W.w().rowsBetween(1, 5))))), 2),
            R(f"CASE WHEN {lag('close', -5)} IS NOT NULL THEN CASE WHEN hi5 = lo5 THEN 0 ELSE (close - lo5) / (hi5 - lo5) END END", 2)),
    }, " , n AS (SELECT *, max(high) OVER f AS hi5, min(low) OVER f AS lo5 FROM b WINDOW f AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) SELECT symbol, dt, {} FROM n")
    zp = lambda k: F.coalesce(W.lag("delta", k), F.lit(0.0))

    def impulse(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = numbered(spark, sf_dir).withColumn("delta", F.coalesce(W.delta("close"), F.lit(0.0)))
        a, b, c = zp(1), zp(2), zp(3)
        punch = F.when((a > 0) & (b <= 0) & (c <= 0), 1).when((a > 0) & (b > 0) & (c <= 0), 666).otherwise(0)
        return df.select("symbol", "dt", punch.cast("bigint").alias("punch"))

    QUERIES["impulse_punch"] = impulse
    ORACLES["impulse_punch"] = with_bars(f""", d AS (SELECT *, coalesce(close - {lag('close')}, 0) AS delta FROM b),
      x AS (SELECT symbol, dt, coalesce({lag('delta', 1)}, 0) a, coalesce({lag('delta', 2)}, 0) b, coalesce({lag('delta', 3)}, 0) c FROM d)
      SELECT symbol, dt, CASE WHEN a > 0 AND b <= 0 AND c <= 0 THEN 1 WHEN a > 0 AND b > 0 AND c <= 0 THEN 666 ELSE 0 END::BIGINT AS punch FROM x""")

    def zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = W.zscore(numbered(spark, sf_dir), "close", 84, "z")
        every = (F.col("close") - F.avg("close").over(W.whole())) / F.stddev_pop("close").over(W.whole())
        return df.select("symbol", "dt", r(F.col("z")).alias("z84"), r(every).alias("z_all"))

    QUERIES["zscore_84"] = zscores
    ORACLES["zscore_84"] = with_bars(f""" SELECT symbol, dt, (round({full(f"(close - avg(close) {over(84)}) / nullif(stddev_pop(close) {over(84)}, 0)", 84)} + 1e-7::DOUBLE, 4) + 0::DOUBLE) AS z84,
      (round((close - avg(close) {P}) / stddev_pop(close) {P} + 1e-7::DOUBLE, 4) + 0::DOUBLE) AS z_all FROM b""")

    def hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = W.hma(W.hma(W.wma(numbered(spark, sf_dir), "close", 10, "wma_10"), "close", 10, "hma_10"), "close", 5, "hma_5")
        return df.select("symbol", "dt", *[r(F.col(c), 3).alias(c) for c in ("wma_10", "hma_10", "hma_5")])

    def swma(c: str, n: int, after: int = 0) -> str:
        terms = " + ".join(f"{n - j} * {c if not j else lag(c, j)}" for j in range(n))
        return f"CASE WHEN rn >= {n + after} THEN ({terms}) / {n * (n + 1) / 2}::DOUBLE END"

    QUERIES["wma_hma_10"] = hulls
    ORACLES["wma_hma_10"] = with_bars(f""", x AS (SELECT *, {swma('close', 10)} AS w10, 2 * {swma('close', 5)} - {swma('close', 10)} AS h10,
      2 * {swma('close', 2)} - {swma('close', 5)} AS h5 FROM b)
      SELECT symbol, dt, (round(w10 + 1e-6::DOUBLE, 3) + 0::DOUBLE) AS wma_10, (round({swma('h10', 3, 9)} + 1e-6::DOUBLE, 3) + 0::DOUBLE) AS hma_10, (round({swma('h5', 2, 4)} + 1e-6::DOUBLE, 3) + 0::DOUBLE) AS hma_5 FROM x""")

    def smooth_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = numbered(spark, sf_dir).withColumn("s", F.avg("close").over(W.w().rowsBetween(-2, 2)))
        df = df.withColumn("inner", (F.col("rn") > 2) & (F.count("*").over(W.w().rowsBetween(0, 2)) == 3))
        df = df.withColumn("s", F.when(F.col("inner"), F.col("s")))
        s, a, b = F.col("s"), W.lag("s"), W.lag("s", -1)
        return df.select("symbol", "dt", r(s).alias("smooth"), F.when((s < a) & (s < b), 1).when((s > a) & (s > b), -1).otherwise(0).cast("bigint").alias("mark"))

    QUERIES["savgol_extrema"] = smooth_extrema
    ORACLES["savgol_extrema"] = with_bars(f""", x AS (SELECT symbol, dt, rn, CASE WHEN rn > 2 AND lead(close, 2) {OW} IS NOT NULL THEN
        avg(close) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS s FROM b)
      SELECT symbol, dt, (round(s + 1e-7::DOUBLE, 4) + 0::DOUBLE) AS smooth, CASE WHEN s < lag(s) {OW} AND s < lead(s) {OW} THEN 1 WHEN s > lag(s) {OW} AND s > lead(s) {OW} THEN -1 ELSE 0 END::BIGINT AS mark FROM x""")

    def rps(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = numbered(spark, sf_dir).withColumn("ret", F.coalesce(W.pct_change("close", 63), F.lit(0.0)))
        return W.ranked(df, "ret", "rps")

    def rps_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rps(spark, sf_dir).select("symbol", "dt", r(F.col("ret"), 6).alias("ret"), F.col("rps_rank"), r(F.col("rps_pct"), 6).alias("rps_pct"))

    QUERIES["rps_rank_63"] = rps_rank
    base = f""", x AS (SELECT symbol, dt, coalesce(close / lag(close, 63) {OW} - 1, 0)::DOUBLE AS ret FROM b),
      y AS (SELECT *, rank() OVER (PARTITION BY dt ORDER BY ret DESC) + (count(*) OVER (PARTITION BY dt, ret) - 1) / 2::DOUBLE AS rps_rank, count(*) OVER (PARTITION BY dt) AS n FROM x)"""
    ORACLES["rps_rank_63"] = with_bars(base + " SELECT symbol, dt, (round(ret + 1e-9::DOUBLE, 6) + 0::DOUBLE) AS ret, rps_rank, (round(rps_rank / n + 1e-9::DOUBLE, 6) + 0::DOUBLE) AS rps_pct FROM y")

    def rps_top(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the last date first: its rows are few, the returns need the symbols' history only
        df = numbered(spark, sf_dir).withColumn("ret", F.coalesce(W.pct_change("close", 63), F.lit(0.0)))
        last = df.agg(F.max("dt").alias("dt"))
        df = W.ranked(df.join(F.broadcast(last), "dt"), "ret", "rps")
        return df.orderBy("rps_rank", "symbol").limit(20).select("symbol", "dt", r(F.col("ret"), 6).alias("ret"), "rps_rank", r(F.col("rps_pct"), 6).alias("rps_pct"))

    QUERIES["rps_top20"] = rps_top
    ORACLES["rps_top20"] = with_bars(base + " SELECT symbol, dt, (round(ret + 1e-9::DOUBLE, 6) + 0::DOUBLE) AS ret, rps_rank, (round(rps_rank / n + 1e-9::DOUBLE, 6) + 0::DOUBLE) AS rps_pct FROM y WHERE dt = (SELECT max(dt) FROM y) ORDER BY rps_rank, symbol LIMIT 20")

    def risk_free(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = numbered(spark, sf_dir).withColumn("__n", F.count("*").over(W.whole()))
        top = F.pow(F.lit(1.04), F.col("__n") / 252.0)
        df = df.withColumn("base", 1 + (top - 1) * (F.col("rn") - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
        return df.select("symbol", "dt", r(F.col("base"), 6).alias("base"), r(W.pct_change("base", 63), 6).alias("roc"), r(W.ols_slope("base", 14), 7).alias("slope"))

    QUERIES["risk_free_baseline"] = risk_free
    ORACLES["risk_free_baseline"] = with_bars(f""", x AS (SELECT *, 1 + (pow(1.04::DOUBLE, count(*) {P} / 252::DOUBLE) - 1) * (rn - 1) / greatest(count(*) {P} - 1, 1) AS base FROM b)
      SELECT symbol, dt, (round(base + 1e-9::DOUBLE, 6) + 0::DOUBLE) AS base, (round(base / lag(base, 63) {OW} - 1 + 1e-9::DOUBLE, 6) + 0::DOUBLE) AS roc, (round({full(f"regr_slope(base, rn) {over(14)}", 14)} + 1e-10::DOUBLE, 7) + 0::DOUBLE) AS slope FROM x""")


build()
