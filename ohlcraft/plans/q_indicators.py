"""Queries of recurrences, compound indicators, patterns and structures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import window as W
from ..operators import indicators as I
from ..operators import kernels as K
from ..operators import patterns, structure
from ..sources.bars import day_bars
from .oracle import BARS, UPTO, full, over, run, since, sma, with_bars
from .oracle import W as OW
from .q_window import R, numbered, r

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def ema(x: str, n: int) -> str:
    return f"list_reduce(list({x}) {UPTO}, lambda e, v: (2 * v + {n - 1} * e) / {n + 1})"


def pick(df: DataFrame, floats: dict[str, int], ints: tuple[str, ...] = ()) -> DataFrame:
    return df.select("symbol", "dt", *[r(F.col(c), k).alias(c) for c, k in floats.items()], *ints)


MACD = f", e AS (SELECT *, {ema('close', 12)} - {ema('close', 26)} AS dif FROM b), f AS (SELECT *, {ema('dif', 9)} AS dea FROM e), m AS (SELECT *, 2 * (dif - dea) AS macd FROM f)"


@query(with_bars(MACD + f" SELECT symbol, dt, {R('dif', 3)} AS dif, {R('dea', 3)} AS dea, {R('macd', 3)} AS macd FROM m"))
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(I.macd_frame(day_bars(spark, sf_dir)), {"dif": 3, "dea": 3, "macd": 3})


_Z = MACD + f""", z AS (SELECT symbol, dt, rn, CASE WHEN rn > 24 THEN dif ELSE 0 END AS dif, CASE WHEN rn > 31 THEN dea ELSE 0 END AS dea, CASE WHEN rn > 31 THEN macd ELSE 0 END AS macd FROM m),
 l AS (SELECT *, coalesce(lag(dif) {OW}, 0) AS dif1, coalesce(lag(dea) {OW}, 0) AS dea1, coalesce(lag(macd) {OW}, 0) AS macd1 FROM z),
 s AS (SELECT *, {since('dea < 0 AND dea1 >= 0')} AS dd, {since('macd < 0 AND macd1 >= 0')} AS md, (CASE WHEN macd > 0 AND macd > macd1 THEN 1 WHEN macd < 0 AND macd < macd1 THEN -1 ELSE 0 END)::BIGINT AS state FROM l),
 n AS (SELECT *, (macd < 0 AND dea < 0 AND macd < dea) OR (macd < 0 AND ((dea < 0 AND (dd > 6 OR md > 12)) OR (dif < 0 AND md > 12)) AND macd < dea AND abs(macd) > abs(dea)) AS low FROM s)"""


@query(with_bars(_Z + f""" SELECT symbol, dt, (CASE WHEN macd > 0 AND macd1 < 0 THEN 1 WHEN macd < 0 AND macd1 > 0 THEN -1 ELSE 0 END)::BIGINT AS cross_, state, dd AS dea_down_before, md AS macd_down_before,
 low::BIGINT AS negative_lower, (NOT low AND dea < 0 AND macd > macd1)::BIGINT AS lower_settle, (dea > 0 AND macd > dea)::BIGINT AS higher_settle, {run('state > 0')} - ({run('state < 0')}) AS run,
 {R(full(f"regr_slope(dea, rn) {over(14)}", 14), 3)} AS dea_slope, {R(full(f"sum((sign(dea) <> sign(dea1))::INT) {over(252)}", 252) + " / 2::DOUBLE")} AS turnover FROM n"""))
def macd_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = I.macd_cross(day_bars(spark, sf_dir)).withColumnRenamed("cross", "cross_")
    ints = ("cross_", "state", "dea_down_before", "macd_down_before", "negative_lower", "lower_settle", "higher_settle", "run")
    return pick(df, {"dea_slope": 3, "turnover": 4}, ints)


def recursive(parts: str, body: str) -> str:
    return f"WITH RECURSIVE {BARS}{parts} {body}"


_KDJ = f""", h AS (SELECT *, round(max(high) {over(9)} + 1e-5::DOUBLE, 2) AS hh, round(min(low) {over(9)} + 1e-5::DOUBLE, 2) AS ll FROM b),
 v AS (SELECT symbol, dt, rn, CASE WHEN hh = ll THEN 0 ELSE (close - ll) / (hh - ll) * 100 END AS rsv FROM h),
 k AS (SELECT symbol, dt, rn, rsv AS k, rsv AS d FROM v WHERE rn = 1 UNION ALL SELECT v.symbol, v.dt, v.rn, CASE WHEN v.rn < 9 THEN v.rsv ELSE k.k * 2 / 3 + v.rsv / 3 END,
   CASE WHEN v.rn < 9 THEN v.rsv ELSE k.d * 2 / 3 + (k.k * 2 / 3 + v.rsv / 3) / 3 END FROM k JOIN v ON v.symbol = k.symbol AND v.rn = k.rn + 1)"""


@query(recursive(_KDJ, f"SELECT symbol, dt, {R('k', 2)} AS k, {R('d', 2)} AS d, {R('3 * k - 2 * d', 2)} AS j FROM k"))
def kdj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(I.kdj_frame(day_bars(spark, sf_dir)), {"k": 2, "d": 2, "j": 2})


@query()
def kdj_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(I.kdj_cross(day_bars(spark, sf_dir)), {"j": 2}, ("golden", "dead", "state", "run"))


def wilder(source: str, n: int, out: str, first: int) -> str:
    """Recursive Wilder mean of column x of source, whose first value is in row first."""
    return f""", {out}s AS (SELECT *, avg(x) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS seed FROM {source}),
 {out} AS (SELECT symbol, rn, seed AS e FROM {out}s WHERE rn = {first + n - 1} UNION ALL SELECT s.symbol, s.rn, (e * {n - 1} + s.x) / {n} FROM {out} w JOIN {out}s s ON s.symbol = w.symbol AND s.rn = w.rn + 1)"""


_RSI = f""", d AS (SELECT *, close - lag(close) {OW} AS c1 FROM b), u AS (SELECT symbol, dt, rn, greatest(c1, 0) AS x FROM d WHERE rn > 1), n AS (SELECT symbol, dt, rn, greatest(-c1, 0) AS x FROM d WHERE rn > 1)""" + wilder("u", 6, "wu", 2) + wilder("n", 6, "wd", 2)


@query(recursive(_RSI, f"SELECT b.symbol, b.dt, {R('CASE WHEN wu.e + wd.e = 0 THEN 0 ELSE 100 * wu.e / (wu.e + wd.e) END', 3)} AS rsi_6 FROM b LEFT JOIN wu ON wu.symbol = b.symbol AND wu.rn = b.rn LEFT JOIN wd ON wd.symbol = b.symbol AND wd.rn = b.rn"))
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(I.rsi_frame(day_bars(spark, sf_dir), (6,)), {"rsi_6": 3})


@query()
def rsi_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(I.rsi_cross(day_bars(spark, sf_dir)), {"rsi_6": 3}, ("state", "run"))


def _atr(n: int) -> str:
    tr = f", t AS (SELECT *, greatest(high - low, abs(high - lag(close) {OW}), abs(low - lag(close) {OW})) AS x0 FROM b), tr AS (SELECT symbol, dt, rn, x0 AS x FROM t WHERE rn > 1)"
    return tr + wilder("tr", n, "wa", 2)


@query(recursive(_atr(14), f"SELECT b.symbol, b.dt, {R('wa.e', 3)} AS atr FROM b LEFT JOIN wa ON wa.symbol = b.symbol AND wa.rn = b.rn"))
def atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(I.atr_frame(day_bars(spark, sf_dir)), {"atr": 3})


_ST = _atr(12) + """, y AS (SELECT b.*, (high + low) / 2 - 3 * wa.e AS up, (high + low) / 2 + 3 * wa.e AS dn, lag(close) OVER (PARTITION BY b.symbol ORDER BY b.rn) AS c1 FROM b JOIN wa ON wa.symbol = b.symbol AND wa.rn = b.rn),
 s AS (SELECT symbol, dt, rn, up AS u, dn AS d, 1::BIGINT AS t FROM y WHERE rn = 13 UNION ALL
   SELECT y.symbol, y.dt, y.rn, CASE WHEN c1 > s.u THEN greatest(up, s.u) ELSE up END, CASE WHEN c1 < s.d THEN least(dn, s.d) ELSE dn END,
          CASE WHEN s.t = -1 AND y.close > s.d THEN 1 WHEN s.t = 1 AND y.close < s.u THEN -1 ELSE s.t END FROM s JOIN y ON y.symbol = s.symbol AND y.rn = s.rn + 1)"""


@query(recursive(_ST, f"SELECT b.symbol, b.dt, {R('CASE WHEN t = 1 THEN u ELSE d END', 2)} AS st_line, coalesce(t, 0) AS st_trend FROM b LEFT JOIN s ON s.symbol = b.symbol AND s.rn = b.rn"))
def supertrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(h, low, c):
        line, t = K.supertrend(h, low, c)
        return {"st_line": line, "st_trend": t}

    return pick(I.with_kernel(day_bars(spark, sf_dir), ["high", "low", "close"], "st_line double, st_trend bigint", kernel, []), {"st_line": 2}, ("st_trend",))


@query()
def trend_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ("st_trend", "atr_trend", "vhma_dir", "lr_dir", "st_trend_run", "atr_trend_run", "vhma_dir_run", "lr_dir_run")
    return pick(I.trend_frame(day_bars(spark, sf_dir)), {c: 2 for c in ("st_line", "atr_ub", "atr_lb", "vhma", "lr_line", "lr_ub", "lr_lb")}, runs)


@query(recursive(f""", d AS (SELECT symbol, dt, rn, (CASE WHEN close > open THEN 0.0309 WHEN close < open THEN -0.0309 ELSE 0 END)::DOUBLE AS v FROM b),
 p AS (SELECT symbol, dt, rn, least(1, greatest(0, v)) AS p, 0::DOUBLE AS q FROM d WHERE rn = 1 UNION ALL SELECT d.symbol, d.dt, d.rn, least(1, greatest(0, p.p + d.v)), p.p FROM p JOIN d ON d.symbol = p.symbol AND d.rn = p.rn + 1)""",
 f"SELECT symbol, dt, {R('p')} AS leverage, {R('q')} AS leverage_before FROM p"))
def leverage_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = day_bars(spark, sf_dir).withColumn("v", F.when(F.col("close") > F.col("open"), 0.0309).when(F.col("close") < F.col("open"), -0.0309).otherwise(0.0))
    return pick(I.smart_leverage(b.select("symbol", "dt", "v"), "v"), {"leverage": 4, "leverage_before": 4})


_TAPS = ", ".join(repr(float(x)) for x in K.chebyshev_taps())


@query(with_bars(f" SELECT symbol, dt, {R('CASE WHEN rn >= 252 THEN list_dot_product(list(close) ' + over(252) + f', CASE WHEN rn >= 252 THEN [{_TAPS}]::DOUBLE[] END) END', 2)} AS poly9 FROM b"))
def poly9_fir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(I.poly9(day_bars(spark, sf_dir)), {"poly9": 2})


_MAS = ", ".join(f"avg(close) {over(n)}" for n in range(5, 30))


@query(with_bars(f", p AS (SELECT symbol, dt, rn, [{_MAS}] AS v FROM b) SELECT symbol, dt, {R('CASE WHEN rn < 29 THEN 0 ELSE list_sum(list_transform(v, lambda x, i: len(list_filter(v[i + 1:], lambda y: x > y)))) * 2 / 600::DOUBLE END')} AS power FROM p"))
def ma_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(I.ma_power(day_bars(spark, sf_dir)), {"power": 4})


_MA = ", ".join(f"{sma('close', n)} AS ma{n}" for n in I.MA_LENGTHS)


def _cross(a: str, b: str) -> str:
    return f"({a} > {b} AND lag({a}) {OW} <= lag({b}) {OW})"


@query(with_bars(f""", a AS (SELECT *, {_MA} FROM b), c AS (SELECT *, coalesce({_cross('ma5', 'ma10')}, false) AS u, coalesce({_cross('ma10', 'ma5')}, false) AS d, coalesce({_cross('ma90', 'ma120')}, false) AS u2 FROM a)
 SELECT symbol, dt, {R('ma5')} AS ma5, {R('ma120')} AS ma120, (CASE WHEN u THEN 1 WHEN d THEN -1 ELSE 0 END)::BIGINT AS cross_5_10, {since('u')} AS jx_5_10, {since('d')} AS sx_5_10, {since('u2')} AS jx_90_120,
 {run('ma5 > ma10 AND ma10 > ma20 AND ma20 > ma30')} AS aligned_run FROM c"""))
def ma_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(I.ma_system(day_bars(spark, sf_dir)), {"ma5": 4, "ma120": 4}, ("cross_5_10", "jx_5_10", "sx_5_10", "jx_90_120", "aligned_run"))


_BB = f"{sma('close', 20)} AS mid, {full(f'stddev_pop(close) {over(20)}', 20)} AS sd"


@query(with_bars(f", a AS (SELECT *, {_MA}, {_BB} FROM b), c AS (SELECT *, mid + 2 * sd AS ub, mid - 2 * sd AS lb FROM a) SELECT symbol, dt, {R('(ub - close) / nullif(ub - lb, 0)')} AS clear_close, {R('(ub - ma60) / nullif(ub - lb, 0)')} AS clear_ma60, {R('CASE WHEN ma120 IS NOT NULL THEN (greatest(ma5, ma10, ma20, ma30, ma60, ma90, ma120) - least(ma5, ma10, ma20, ma30, ma60, ma90, ma120)) / ma20 END')} AS ma_channel FROM c"))
def ma_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(I.clearances(day_bars(spark, sf_dir)), {"clear_close": 4, "clear_ma60": 4, "ma_channel": 4})


@query(with_bars(f""", a AS (SELECT *, {_BB}, {sma('low', 3)} AS lo, {sma('high', 3)} AS hi FROM b), c AS (SELECT *, mid + 2 * sd AS ub, mid - 2 * sd AS lb FROM a),
 x AS (SELECT *, coalesce({_cross('lo', 'lb')}, false) AS jx, coalesce({_cross('ub', 'hi')}, false) AS sx FROM c)
 SELECT symbol, dt, jx::BIGINT AS jx, sx::BIGINT AS sx, {since('jx')} AS jx_before, {since('sx')} AS sx_before, ({since('sx')}) - ({since('jx')}) AS trend FROM x"""))
def boll_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.boll_cross(day_bars(spark, sf_dir)).select("symbol", "dt", "jx", "sx", "jx_before", "sx_before", "trend")


def _at(cond: str) -> str:
    return f"last_value(CASE WHEN {cond} THEN close END IGNORE NULLS) {UPTO}"


@query(with_bars(f", a AS (SELECT *, {_BB} FROM b), c AS (SELECT *, {_at('close > mid + 2 * sd')} AS hi, {_at('close < mid - 2 * sd')} AS lo FROM a) SELECT symbol, dt, {R('hi')} AS high_at, {R('lo')} AS low_at, {R('(close - hi) / hi')} AS drawdown, {R('(close - lo) / lo')} AS rise FROM c"))
def bollinger_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(I.bollinger_box(day_bars(spark, sf_dir)), {c: 4 for c in ("high_at", "low_at", "drawdown", "rise")})


_FLOW = f", l AS (SELECT *, coalesce(ln(close / lag(close) {OW}), 0) AS lr FROM b), f AS (SELECT *, sign(sum(lr) {over(4)}) * avg(volume) {over(4)} AS flow, sum(CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) * volume END) {UPTO} AS ad FROM l)"


@query(with_bars(_FLOW + f" SELECT symbol, dt, {R('flow')} AS flow, {R('ad', 2)} AS ad, {R(sma('volume', 5))} AS vol5, {R(full(f'len(list_filter(list(flow) {over(21)}, lambda v: v <= flow)) / 21', 21))} AS rank21, {run('flow > 0')} - ({run('flow < 0')}) AS flow_run FROM f"))
def volume_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(I.volume_flow(day_bars(spark, sf_dir)), {"flow": 4, "ad": 2, "vol5": 4, "rank21": 4}, ("flow_run",))


_BIAS = ", ".join(f"100 * (close - {sma('close', n)}) / {sma('close', n)} AS b{n}" for n in (10, 20, 30))


@query(with_bars(f", a AS (SELECT *, {_BIAS} FROM b), s AS (SELECT *, (CASE WHEN b10 > 0 AND b20 > 0 AND b30 > 0 THEN 1 WHEN b10 < 0 AND b20 < 0 AND b30 < 0 THEN -1 ELSE 0 END)::BIGINT AS agree, (CASE WHEN b10 > 0 AND lag(b10) {OW} <= 0 THEN 1 WHEN b10 < 0 AND lag(b10) {OW} >= 0 THEN -1 ELSE 0 END)::BIGINT AS cross_ FROM a) SELECT symbol, dt, {R('b10')} AS bias_10, cross_, agree, {run('agree > 0')} - ({run('agree < 0')}) AS run FROM s"))
def bias_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(I.bias_cross(day_bars(spark, sf_dir)).withColumnRenamed("cross", "cross_"), {"bias_10": 4}, ("cross_", "agree", "run"))


@query()
def adx_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(I.adxm(day_bars(spark, sf_dir)), {"adx": 3, "plus": 6, "minus": 6}, ("direction",))


@query()
def maxfactor_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(I.maxfactor_cross(day_bars(spark, sf_dir)), {"maxfactor": 2, "maxfactor_ma": 2}, ("state", "dual", "up_before", "down_before", "run", "dual_run"))


@query()
def peak_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.peaks(day_bars(spark, sf_dir)).select("symbol", "dt", "peak", "points", "eager")


@query()
def combo_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = I.boll_cross(day_bars(spark, sf_dir)).select("symbol", "dt", "close", "jx", "sx")
    df = W.numbered(I.cross_density(b, "jx", "sx"))
    return pick(I.combo_flow(df, ["density"]), {"density": 4, "combo_ma": 4, "combo_slope": 6}, ("window", "combo_cross", "combo_run"))


@query()
def candle_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = patterns.patterns(day_bars(spark, sf_dir))
    return df.select("symbol", "dt", *[F.col(c).cast("bigint") for c in df.columns if c.startswith("p_")], F.col("patterns").cast("bigint"))


@query()
def chan_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.merged(day_bars(spark, sf_dir))


@query()
def chan_fractals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.marked_fractals(structure.merged(day_bars(spark, sf_dir)))


@query()
def chan_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.points(day_bars(spark, sf_dir)).where("kind <> 'fx'")


@query()
def chan_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.pivot_table(structure.points(day_bars(spark, sf_dir)))


@query()
def chan_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = day_bars(spark, sf_dir)
    m = I.macd_frame(b).select("symbol", "dt", "volume", "macd")
    return structure.leg_signals(structure.legs(structure.points(b), m))


@query()
def chan_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.selected(chan_signals(spark, sf_dir)).select("symbol", "t2", "direction", "rule")


@query()
def chan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = day_bars(spark, sf_dir)
    return structure.marked_bars(b, structure.points(b)).select("symbol", "dt", "fx", "bi", "xd")


@query(with_bars(f" SELECT symbol, dt, rn::BIGINT AS i, {R('close')} AS close, {R('min(low) OVER f')} AS low60, {R('max(high) OVER f')} AS high60, (low = min(low) OVER f)::BIGINT AS is_low, (high = max(high) OVER f)::BIGINT AS is_high FROM b WINDOW f AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 30 PRECEDING AND 29 FOLLOWING)"))
def wave_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = W.w().rowsBetween(-30, 29)
    lo, hi = F.min("low").over(f), F.max("high").over(f)
    return numbered(spark, sf_dir).select("symbol", "dt", F.col("rn").alias("i"), r(F.col("close")).alias("close"), r(lo).alias("low60"), r(hi).alias("high60"), (F.col("low") == lo).cast("bigint").alias("is_low"), (F.col("high") == hi).cast("bigint").alias("is_high"))


ORACLES["kdj_cross"] = recursive(
    _KDJ + f""", j AS (SELECT *, 3 * k - 2 * d AS j, lag(k) {OW} AS k1, lag(d) {OW} AS d1 FROM k),
 s AS (SELECT *, (CASE WHEN j > d THEN 1 WHEN j < d THEN -1 ELSE 0 END)::BIGINT AS state FROM j)""",
    f"""SELECT symbol, dt, {R('j', 2)} AS j, coalesce(k > d AND k1 <= d1 AND d <= 30, false)::BIGINT AS golden, coalesce(d > k AND d1 <= k1 AND d >= 70, false)::BIGINT AS dead,
 state, {run('state > 0')} - ({run('state < 0')}) AS run FROM s""",
)

_UPS = f""", dd AS (SELECT *, close - lag(close) {OW} AS c1 FROM b), up_ AS (SELECT symbol, dt, rn, greatest(c1, 0) AS x FROM dd WHERE rn > 1), dn_ AS (SELECT symbol, dt, rn, greatest(-c1, 0) AS x FROM dd WHERE rn > 1)"""


def _rsi_of(*lengths: int) -> str:
    parts = "".join(wilder("up_", n, f"u{n}_", 2) + wilder("dn_", n, f"d{n}_", 2) for n in lengths)
    joins = " ".join(f"LEFT JOIN u{n}_ ON u{n}_.symbol = b.symbol AND u{n}_.rn = b.rn LEFT JOIN d{n}_ ON d{n}_.symbol = b.symbol AND d{n}_.rn = b.rn" for n in lengths)
    values = ", ".join(f"CASE WHEN u{n}_.e + d{n}_.e = 0 THEN 0 ELSE 100 * u{n}_.e / (u{n}_.e + d{n}_.e) END AS r{n}" for n in lengths)
    return f"{_UPS}{parts}, rs AS (SELECT b.symbol, b.dt, b.rn, b.close, {values} FROM b {joins})"


ORACLES["rsi_cross"] = recursive(
    _rsi_of(6, 12, 24) + ", st AS (SELECT *, (CASE WHEN r6 > r12 AND r12 > r24 THEN 1 WHEN r6 < r12 AND r12 < r24 THEN -1 ELSE 0 END)::BIGINT AS state FROM rs)",
    f"SELECT symbol, dt, {R('r6', 3)} AS rsi_6, state, {run('state > 0')} - ({run('state < 0')}) AS run FROM st",
)


@query(recursive(_atr(14) + f", g AS (SELECT b.*, {full(f'regr_intercept(close, b.rn) OVER w + regr_slope(close, b.rn) OVER w * b.rn', 20).replace('rn >=', 'b.rn >=')} AS line, wa.e AS a FROM b LEFT JOIN wa ON wa.symbol = b.symbol AND wa.rn = b.rn WINDOW w AS (PARTITION BY b.symbol ORDER BY b.dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))",
                 f"SELECT symbol, dt, {R('line', 2)} AS lr_line, {R('line + a', 2)} AS lr_ub, {R('line - a', 2)} AS lr_lb, coalesce(sign(line - lag(line) {OW}), 0)::BIGINT AS lr_dir FROM g"))
def linreg_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(h, low, c):
        line, up, down, way = K.linreg_band(h, low, c)
        return {"lr_line": line, "lr_ub": up, "lr_lb": down, "lr_dir": way}

    found = I.with_kernel(day_bars(spark, sf_dir), ["high", "low", "close"], "lr_line double, lr_ub double, lr_lb double, lr_dir bigint", kernel, [])
    return pick(found, {"lr_line": 2, "lr_ub": 2, "lr_lb": 2}, ("lr_dir",))


@query(recursive(""", k AS (SELECT symbol, dt, rn, close AS level, 0::BIGINT AS bricks FROM b WHERE rn = 1 UNION ALL
 SELECT b.symbol, b.dt, b.rn, CASE WHEN abs(b.close - k.level) >= 500 THEN k.level + trunc((b.close - k.level) / 500) * 500 ELSE k.level END, CASE WHEN abs(b.close - k.level) >= 500 THEN trunc((b.close - k.level) / 500) ELSE 0 END::BIGINT
 FROM k JOIN b ON b.symbol = k.symbol AND b.rn = k.rn + 1)""", f"SELECT symbol, dt, {R('level')} AS level, bricks FROM k"))  # fmt: skip
def renko_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ml import renko

    def kernel(c):
        level, bricks, _, _ = renko(c, 500.0)
        return {"level": level, "bricks": bricks}

    return pick(I.with_kernel(day_bars(spark, sf_dir), ["close"], "level double, bricks bigint", kernel, []), {"level": 4}, ("bricks",))


_CANDLE = f""", c0 AS (SELECT *, abs(close - open) AS body, high - low AS rng, high - greatest(open, close) AS up, least(open, close) - low AS dn, greatest(open, close) AS top, least(open, close) AS bot, CASE WHEN close >= open THEN 1 ELSE -1 END AS d FROM b),
 c1 AS (SELECT *, avg(body) OVER w AS ab, avg(rng) OVER w AS ar FROM c0 WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
 c2 AS (SELECT *, lag(open) {OW} AS o1, lag(close) {OW} AS c1, lag(top) {OW} AS t1, lag(bot) {OW} AS b1, lag(d) {OW} AS d1, lag(body) {OW} AS body1, lag(ab) {OW} AS ab1 FROM c1)"""


@query(with_bars(_CANDLE + """ SELECT symbol, dt, (CASE WHEN body <= 0.1::DOUBLE * ar THEN 100 ELSE 0 END)::BIGINT AS doji,
 (CASE WHEN d = 1 AND d1 = -1 AND close >= o1 AND open <= c1 AND (close > o1 OR open < c1) THEN 100 WHEN d = -1 AND d1 = 1 AND open >= c1 AND close <= o1 AND (open > c1 OR close < o1) THEN -100 ELSE 0 END)::BIGINT AS engulfing,
 (CASE WHEN body > ab AND up < 0.1::DOUBLE * ar AND dn < 0.1::DOUBLE * ar THEN 100 * d ELSE 0 END)::BIGINT AS marubozu,
 (CASE WHEN body1 > ab1 AND body < ab AND top < t1 AND bot > b1 THEN -100 * d1 ELSE 0 END)::BIGINT AS harami,
 (CASE WHEN body < ab AND up > body AND dn > body THEN 100 * d ELSE 0 END)::BIGINT AS spinningtop FROM c2"""))  # fmt: skip
def candle_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = patterns.patterns(day_bars(spark, sf_dir))
    return df.select("symbol", "dt", *[F.col(f"p_{c}").cast("bigint").alias(c) for c in ("doji", "engulfing", "marubozu", "harami", "spinningtop")])
