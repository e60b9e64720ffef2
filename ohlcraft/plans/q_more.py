"""More queries, and SQL for queries of other modules whose recurrences need a longer chain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions import window as W
from ..operators import indicators as I
from ..operators import market
from ..sources import bars as B
from ..sources.bars import day_bars
from .oracle import UPTO, P, full, over, run, since, sma, with_bars
from .oracle import W as OW
from .q_indicators import _KDJ, _ST, _rsi_of, ema, pick, recursive
from .q_relational import RET, returns
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


def lag(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) {OW}"


def wma_sql(c: str, n: int, after: int = 0) -> str:
    return full(f"(sum({c} * rn) {over(n)} - (rn - {n}) * sum({c}) {over(n)}) / {n * (n + 1) / 2}::DOUBLE", n + after)


def hma_sql(source: str, to: str, c: str, n: int, out: str) -> str:
    """Hull mean of a column as two common tables."""
    return f", {to}0 AS (SELECT *, 2 * {wma_sql(c, n // 2)} - {wma_sql(c, n)} AS raw_{out} FROM {source}), {to} AS (SELECT * EXCLUDE (raw_{out}), {wma_sql(f'raw_{out}', int(n**0.5 + 0.5), n - 1)} AS {out} FROM {to}0)"


_CCI = f"""tp AS (SELECT *, (high + low + close) / 3 AS tp FROM b), tw AS (SELECT *, list(tp) {over(14)} AS win FROM tp), tm AS (SELECT *, list_avg(win) AS mean, list_avg(list_transform(win, lambda v: abs(v - list_avg(win)))) AS dev FROM tw),
 cc AS (SELECT symbol, dt, rn, CASE WHEN rn < 14 THEN 0 WHEN dev = 0 THEN 0 ELSE (tp - mean) / (0.015::DOUBLE * dev) END AS cci FROM tm)"""

#: cci, rsi of 12 and j of each bar, then MAXFACTOR with its mean and the two states.
FACTORS = (
    _rsi_of(12)
    + _KDJ
    + f""", {_CCI}, ft AS (SELECT rs.symbol, rs.dt, rs.rn, rs.close, cci, coalesce(r12, 0) AS rsi, 3 * k - 2 * d AS j FROM rs JOIN cc ON cc.symbol = rs.symbol AND cc.rn = rs.rn JOIN k ON k.symbol = rs.symbol AND k.rn = rs.rn),
 mx AS (SELECT *, cci + 4 * (rsi - 50) + 4 * (j - 50) AS maxfactor, 2 * j - {lag('j')} AS jn FROM ft), my AS (SELECT *, {ema('maxfactor', 5)} AS ma FROM mx),
 mz AS (SELECT *, coalesce(maxfactor > ma AND {lag('maxfactor')} <= {lag('ma')}, false) AS up, coalesce(ma > maxfactor AND {lag('ma')} <= {lag('maxfactor')}, false) AS down, sign(maxfactor - ma)::BIGINT AS state,
   (CASE WHEN rn <= 13 THEN 0 WHEN cci > 4 * (rsi - 50) AND (j > rsi OR jn > rsi) THEN 1 WHEN cci < 4 * (rsi - 50) AND (j < rsi OR jn < rsi) THEN -1 ELSE 0 END)::BIGINT AS dual FROM my)"""
)
ORACLES["maxfactor_cross"] = recursive(
    FACTORS,
    f"""SELECT symbol, dt, {R('maxfactor', 2)} AS maxfactor, {R('ma', 2)} AS maxfactor_ma, state, dual, {since('up')} AS up_before, {since('down')} AS down_before,
 {run('state > 0')} - ({run('state < 0')}) AS run, {run('dual > 0')} - ({run('dual < 0')}) AS dual_run FROM mz""",
)

_ADX = f""", d0 AS (SELECT *, coalesce(high / {lag('high')} - 1, 0) AS u, coalesce(-(low / {lag('low')} - 1), 0) AS w, {lag('close')} AS pc FROM b),
 d1 AS (SELECT *, CASE WHEN u > w AND u > 0 THEN u ELSE 0 END AS p, CASE WHEN w > u AND w > 0 THEN w ELSE 0 END AS m, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM d0)"""
_ADX += hma_sql("d1", "hp_", "p", 14, "hp") + hma_sql("hp_", "hm_", "m", 14, "hm") + hma_sql("hm_", "ht_", "tr", 14, "htr")
_ADX += ", d2 AS (SELECT *, 100 * hp / nullif(htr, 0) AS plus, 100 * hm / nullif(htr, 0) AS minus FROM ht_), d3 AS (SELECT *, abs(plus - minus) / nullif(plus + minus, 0) AS dx FROM d2)" + hma_sql("d3", "hd_", "dx", 14, "hdx")
ORACLES["adx_hull"] = with_bars(
    _ADX + f" SELECT symbol, dt, {R('100 * hdx', 3)} AS adx, {R('plus', 6)} AS plus, {R('minus', 6)} AS minus, (CASE WHEN 100 * hdx > 18 THEN CASE WHEN plus > minus THEN 1 ELSE -1 END ELSE 0 END)::BIGINT AS direction FROM hd_"
)


def _detector(name: str, n: int, threshold: int) -> str:
    """z-score detector: the state is the list of the last n filtered values."""
    return f""", {name} AS (SELECT symbol, dt, rn, 0 AS sig, [close] AS held FROM b WHERE rn = 1 UNION ALL
 SELECT symbol, dt, rn, sig, CASE WHEN len(held) < {n} THEN list_append(held, x) ELSE list_append(held[2:], CASE WHEN sig <> 0 THEN 0.5::DOUBLE * x + 0.5::DOUBLE * held[-1] ELSE x END) END
 FROM (SELECT b.symbol, b.dt, b.rn, b.close AS x, p.held, CASE WHEN len(p.held) < {n} THEN 0 WHEN abs(b.close - list_avg(p.held)) > {threshold} * list_stddev_pop(p.held) THEN CASE WHEN b.close > list_avg(p.held) THEN 1 ELSE -1 END ELSE 0 END AS sig
   FROM {name} p JOIN b ON b.symbol = p.symbol AND b.rn = p.rn + 1))"""


@query(recursive(_detector("pa", 10, 3) + _detector("pb", 5, 2), "SELECT pa.symbol, pa.dt, pa.sig::BIGINT AS peak, (9 * pb.sig + 8 * pa.sig)::BIGINT AS points FROM pa JOIN pb ON pb.symbol = pa.symbol AND pb.rn = pa.rn"))
def peak_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """peak_detector without the eager extrema."""
    return I.peaks(day_bars(spark, sf_dir)).select("symbol", "dt", "peak", "points")


def _seeded(source: str, x: str, n: int, out: str, first: int) -> str:
    """Exponential mean seeded with the mean of n rows, as a recursive table."""
    return f""", {out}s AS (SELECT symbol, rn, {x} AS x, avg({x}) {over(n)} AS seed FROM {source}),
 {out} AS (SELECT symbol, rn, seed AS e FROM {out}s WHERE rn = {first + n - 1} UNION ALL SELECT s.symbol, s.rn, e + 2::DOUBLE / {n + 1} * (s.x - e) FROM {out} w JOIN {out}s s ON s.symbol = w.symbol AND s.rn = w.rn + 1)"""


_TREND = _ST + ", q4 AS (SELECT *, (open + high + low + close) / 4 AS o4, close * volume AS cv FROM b)" + _seeded("q4", "o4", 10, "e1", 1).replace("symbol, rn, o4", "symbol, dt, rn, o4")
_TREND += _seeded("q4", "cv", 5, "e2", 1).replace("symbol, rn, cv", "symbol, dt, rn, cv") + _seeded("q4", "volume", 5, "e3", 1).replace("symbol, rn, volume", "symbol, dt, rn, volume")
_TREND += """, wt AS (SELECT symbol, dt, rn, x, avg(x) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS seed FROM tr),
 w10 AS (SELECT symbol, rn, seed AS e FROM wt WHERE rn = 11 UNION ALL SELECT s.symbol, s.rn, (e * 9 + s.x) / 10 FROM w10 w JOIN wt s ON s.symbol = w.symbol AND s.rn = w.rn + 1),
 wu AS (SELECT symbol, dt, rn, x, avg(x) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS seed FROM tr),
 w14 AS (SELECT symbol, rn, seed AS e FROM wu WHERE rn = 15 UNION ALL SELECT s.symbol, s.rn, (e * 13 + s.x) / 14 FROM w14 w JOIN wu s ON s.symbol = w.symbol AND s.rn = w.rn + 1)"""
_TREND += f""", j0 AS (SELECT b.*, CASE WHEN s.t = 1 THEN s.u ELSE s.d END AS st_line, coalesce(s.t, 0) AS st_trend, e1.e + w10.e AS ub, e1.e - w10.e AS lb, e2.e / e3.e AS ratio, w14.e AS a14
   FROM b LEFT JOIN s ON s.symbol = b.symbol AND s.rn = b.rn LEFT JOIN e1 ON e1.symbol = b.symbol AND e1.rn = b.rn LEFT JOIN w10 ON w10.symbol = b.symbol AND w10.rn = b.rn
   LEFT JOIN e2 ON e2.symbol = b.symbol AND e2.rn = b.rn LEFT JOIN e3 ON e3.symbol = b.symbol AND e3.rn = b.rn LEFT JOIN w14 ON w14.symbol = b.symbol AND w14.rn = b.rn),
 j1 AS (SELECT *, (2 * ratio + {lag('ratio')}) / 3 AS half, (5 * ratio + 4 * {lag('ratio')} + 3 * {lag('ratio', 2)} + 2 * {lag('ratio', 3)} + {lag('ratio', 4)}) / 15 AS whole,
   CASE WHEN close > ub AND NOT coalesce({lag('close')} > {lag('ub')}, false) THEN 1 WHEN close < lb AND NOT coalesce({lag('close')} < {lag('lb')}, false) THEN -1 END AS ev,
   {full(f'regr_intercept(close, rn) {over(20)} + regr_slope(close, rn) {over(20)} * rn', 20)} AS line FROM j0),
 j2 AS (SELECT *, 2 * half - whole AS raw, coalesce(last_value(ev IGNORE NULLS) {UPTO}, 0) AS atr_trend, coalesce(sign(line - {lag('line')}), 0) AS lr_dir FROM j1),
 j3 AS (SELECT *, (2 * raw + {lag('raw')}) / 3 AS vhma FROM j2),
 j4 AS (SELECT *, coalesce(sign(vhma - {lag('vhma')}), 0) + coalesce(sign(vhma - {lag('vhma', 2)}), 0) AS v2 FROM j3), j5 AS (SELECT *, CASE WHEN abs(v2) = 2 THEN v2 ELSE 0 END AS vhma_dir FROM j4)"""
_DIRS = ("st_trend", "atr_trend", "vhma_dir", "lr_dir")
ORACLES["trend_lines"] = recursive(
    _TREND,
    f"""SELECT symbol, dt, {R('st_line', 2)} AS st_line, {R('ub', 2)} AS atr_ub, {R('lb', 2)} AS atr_lb, {R('vhma', 2)} AS vhma, {R('line', 2)} AS lr_line, {R('line + a14', 2)} AS lr_ub, {R('line - a14', 2)} AS lr_lb,
 {", ".join(f"{c}::BIGINT AS {c}, {run(f'{c} > 0')} - ({run(f'{c} < 0')}) AS {c}_run" for c in _DIRS)} FROM j5""",
)

_BOX = f"{sma('close', 20)} AS mid, {full(f'stddev_pop(close) {over(20)}', 20)} AS sd"
ORACLES["combo_flow"] = with_bars(
    f""", x0 AS (SELECT *, {_BOX}, {sma('low', 3)} AS lo, {sma('high', 3)} AS hi FROM b), x1 AS (SELECT *, mid + 2 * sd AS ub, mid - 2 * sd AS lb FROM x0),
 x2 AS (SELECT *, coalesce(lo > lb AND {lag('lo')} <= {lag('lb')}, false) AS jx, coalesce(ub > hi AND {lag('ub')} <= {lag('hi')}, false) AS sx FROM x1), x3 AS (SELECT *, {since('jx')} AS ja, {since('sx')} AS sa FROM x2),
 x4 AS (SELECT *, greatest(2, trunc(3.09::DOUBLE * least(median(ja) {P}, median(sa) {P})))::BIGINT AS n, sum(ja) {UPTO} AS cj, sum(sa) {UPTO} AS cs FROM x3),
 x5 AS (SELECT a.*, a.cj - coalesce(z.cj, 0) AS s, a.cs - coalesce(z.cs, 0) AS t FROM x4 a LEFT JOIN x4 z ON z.symbol = a.symbol AND z.rn = a.rn - a.n), x6 AS (SELECT *, 1 - s / (CASE WHEN s + t = 0 THEN 1 ELSE s + t END)::DOUBLE AS density FROM x5),
 x7 AS (SELECT *, {sma('density', 21)} AS ma, {full(f'regr_slope(density, rn) {over(14)}', 14)} AS slope FROM x6)
 SELECT symbol, dt, {R('density')} AS density, {R('ma')} AS combo_ma, {R('slope', 6)} AS combo_slope, n AS "window", coalesce(density > ma AND {lag('density')} <= {lag('ma')}, false)::BIGINT AS combo_cross,
   {run('slope > 0')} - ({run('slope < 0')}) AS combo_run FROM x7"""
)

ORACLES["es_allocation"] = with_bars(
    RET
    + f""", a AS (SELECT symbol, dt, ret FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS age FROM r WHERE ret IS NOT NULL) WHERE age <= 252),
 k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ret, dt) - 1 AS k, count(*) {P} AS n FROM a),
 e AS (SELECT symbol, -sum(CASE WHEN k < n * 0.02::DOUBLE THEN ret ELSE 0 END) / (max(n) * 0.02::DOUBLE) AS es FROM k GROUP BY symbol),
 f AS (SELECT symbol, max(es) OVER () / es * pow(1.02::DOUBLE, symbol % 5) * 10 AS score FROM e WHERE es > 0 ORDER BY score DESC, symbol LIMIT 5),
 g AS (SELECT symbol, score, least(greatest(score / sum(score) OVER (), 0.1::DOUBLE), 0.3::DOUBLE) AS ratio FROM f)
 SELECT symbol::VARCHAR AS symbol, {R('score')} AS score, {R('ratio')} AS ratio FROM g UNION ALL SELECT 'BOND', NULL, {R('greatest(0::DOUBLE, 1 - sum(ratio))')} FROM g"""
)

# queries of what had none


@query(with_bars(f", t AS (SELECT *, close / {lag('close')} - 1 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS back FROM b) SELECT symbol, {R('corr(close, volume)')} AS corr_60 FROM t WHERE back <= 60 GROUP BY symbol"))
def corr_last_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of two columns over the last 60 bars of each symbol."""
    from ..operators.relational import last_correlation

    return last_correlation(day_bars(spark, sf_dir), "close", "volume", 60).select("symbol", r(F.col("corr")).alias("corr_60"))


@query(with_bars(f", t AS (SELECT *, close / {lag('close')} - 1 AS ret, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS back FROM b) SELECT symbol, {R('avg(abs(ret))')} AS move_120, {R('avg(amount)', 2)} AS turnover_120 FROM t WHERE back <= 120 GROUP BY symbol"))
def mean_move_120(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute daily move and mean turnover of the last 120 bars."""
    from ..operators.relational import mean_moves

    return mean_moves(returns(spark, sf_dir), 120).select("symbol", r(F.col("move")).alias("move_120"), r(F.col("turnover"), 2).alias("turnover_120"))


@query(with_bars(f""", f AS (SELECT symbol, dt, volume, close FROM b WHERE rn % 2 = 0), g AS (SELECT symbol, dt, high, low FROM b WHERE rn % 3 = 0)
 SELECT coalesce(f.symbol, g.symbol) AS symbol, coalesce(f.dt, g.dt) AS dt, {R('close')} AS close, {R('high')} AS high FROM f FULL OUTER JOIN g ON f.symbol = g.symbol AND f.dt = g.dt"""))
def aligned_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of one key, each with rows that the other lacks, put side by side."""
    b = numbered(spark, sf_dir)
    f, g = b.where("rn % 2 = 0").select("symbol", "dt", "close"), b.where("rn % 3 = 0").select("symbol", "dt", "high")
    return f.join(g, ["symbol", "dt"], "full_outer").select("symbol", "dt", r(F.col("close")).alias("close"), r(F.col("high")).alias("high"))


_MASS = f""", f AS (SELECT *, close / {lag('close')} - 1 AS ret, {sma('close', 20)} AS ma20, {sma('close', 60)} AS ma60 FROM b),
 d AS (SELECT dt, avg((close > ma20)::INT) AS above, median(ret) AS p1, median(ma20 / ma60 - 1) AS p2 FROM f GROUP BY dt),
 u AS (SELECT *, coalesce((p1 > 0)::INT, 0) + coalesce((p2 > 0)::INT, 0) = 2 AS up, coalesce(above > 0.5, false) AS ov FROM d), l AS (SELECT *, up AND ov AS full_, coalesce(lag(up AND ov) OVER (ORDER BY dt), false) AS before FROM u),
 tr AS (SELECT dt, (CASE WHEN full_ THEN 1 WHEN before AND (up OR ov) THEN 2 WHEN before THEN 3 ELSE 0 END)::BIGINT AS trend FROM l)"""


@query(with_bars(_MASS + f""", j AS (SELECT f.symbol, f.dt, f.rn, f.close, tr.trend FROM f JOIN tr USING (dt)), e AS (SELECT *, trend = 1 AND coalesce({lag('trend')}, 0) <> 1 AS turn FROM j),
 c AS (SELECT *, last_value(CASE WHEN turn THEN close END IGNORE NULLS) {UPTO} AS checkout, {since('turn')} AS age FROM e)
 SELECT symbol, dt, trend, age, {R('checkout')} AS checkout, {R('ln(close / checkout)')} AS since_log FROM c"""))
def attached_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market's trend on the rows of its date, the bars since it last turned up, the close there and the log return since."""
    f = returns(spark, sf_dir).withColumns({"ma20": W.sma("close", 20), "ma60": W.sma("close", 60)}).withColumn("power", F.col("ma20") / F.col("ma60") - 1)
    trend = market.mass_trend(f, ["ret", "power"], "ma20").select("dt", F.col("trend").cast("bigint").alias("trend"))
    df = W.numbered(market.attach_trend(f.select("symbol", "dt", "close"), trend))
    return pick(market.since_turn(df), {"checkout": 4, "since_log": 4}, ("trend", "age"))


@query(with_bars(f", s AS (SELECT *, {full(f'regr_slope(close, rn) {over(14)}', 14)} AS s1, {full(f'regr_slope(close, rn) {over(30)}', 30)} AS s2, {full(f'regr_intercept(close, rn) {over(14)}', 14)} AS i1, {full(f'regr_intercept(close, rn) {over(30)}', 30)} AS i2 FROM b) SELECT symbol, dt, {R('CASE WHEN abs(s1 - s2) > 0.5 THEN (i2 - i1) / (s1 - s2) END', 2)} AS crossing, {R('i1', 2)} AS intercept FROM s"))
def line_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two regression lines meet; nearly parallel ones don't."""
    df = numbered(spark, sf_dir)
    for n, k in ((14, 1), (30, 2)):
        fr = W.frame(n)
        df = df.withColumns({f"s{k}": W.full(F.regr_slope("close", "rn").over(fr), n), f"i{k}": W.full(F.regr_intercept("close", "rn").over(fr), n)})
    apart = F.abs(F.col("s1") - F.col("s2")) > 0.5
    meet = F.when(apart, scalar.line_cross(F.col("i1"), F.col("s1"), F.col("i2"), F.col("s2")))
    return df.select("symbol", "dt", r(meet, 2).alias("crossing"), r(F.col("i1"), 2).alias("intercept"))


@query(with_bars(f", u AS (SELECT *, {run('close > open')} AS up, {since('close > open')} AS gap FROM b), g AS (SELECT *, rn - up AS phase FROM u) SELECT symbol, dt, up, {R('CASE WHEN count(*) OVER w > 2 THEN corr(close, volume) OVER w END', 3)} AS run_corr FROM g WINDOW w AS (PARTITION BY symbol, phase ORDER BY dt)"))
def run_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of close and volume over the current run of rising bars."""
    from pyspark.sql import Window

    df = numbered(spark, sf_dir).withColumn("up", W.run_length(F.col("close") > F.col("open")))
    df = I.wave_corr(df, "up", "close", "volume", "run_corr")
    n = F.count("*").over(Window.partitionBy("symbol", F.col("rn") - F.abs("up")).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0))
    return df.select("symbol", "dt", "up", r(F.when(n > 2, F.col("run_corr")), 3).alias("run_corr"))


@query(with_bars(f", p AS (SELECT *, {lag('close')} AS c1 FROM b), q AS (SELECT *, {full(f'list_sum(list_transform(list(round(100 * (close / c1 - 1))::BIGINT) {over(20)}, lambda v: CASE WHEN v = 10 THEN 1 ELSE 0 END))', 21)} AS tens FROM p) SELECT symbol, dt, tens::BIGINT AS tens FROM q"))
def tens_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the whole percent change was ten in 20 bars."""
    df = numbered(spark, sf_dir).withColumn("whole", F.round(100 * W.pct_change("close")).cast("bigint"))
    return df.select("symbol", "dt", W.full(F.sum((F.col("whole") == 10).cast("bigint")).over(W.frame(20)), 21).alias("tens"))


@query("""WITH t AS (SELECT event_type AS symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS dt, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::BIGINT AS volume FROM events GROUP BY 1, 2)
SELECT symbol, dt, open, high, low, close, volume FROM t WHERE dt::TIME BETWEEN TIME '09:30:00' AND TIME '15:00:00' AND dt >= TIMESTAMP '2024-01-03' AND dt < TIMESTAMP '2024-01-21'""")
def minute_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute bars of a range of dates, within the hours of a session."""
    t = B.ticks(spark, sf_dir).withColumn("w", F.window(F.col("dt").cast("timestamp"), "5 minutes")["start"].cast("timestamp_ntz"))
    bars = t.groupBy("symbol", F.col("w").alias("dt")).agg(F.min_by("price", "dt").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "dt").alias("close"), F.count("*").alias("volume"))
    clock = F.date_format("dt", "HH:mm:ss")
    return bars.where(clock.between("09:30:00", "15:00:00") & (F.col("dt") >= F.lit("2024-01-03").cast("timestamp_ntz")) & (F.col("dt") < F.lit("2024-01-21").cast("timestamp_ntz")))


_PCT = "len(list_filter(list({c}) {o}, lambda v: v <= {c})) / {n}"


def _pct(c: str, n: int) -> str:
    return _PCT.format(c=c, o=over(n), n=n)


_CROSS = f""", t0 AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr0 FROM b), tr AS (SELECT symbol, dt, rn, tr0 AS x FROM t0 WHERE rn > 1),
 wv AS (SELECT *, avg(x) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS seed FROM tr),
 w14 AS (SELECT symbol, rn, seed AS e FROM wv WHERE rn = 15 UNION ALL SELECT s.symbol, s.rn, (e * 13 + s.x) / 14 FROM w14 w JOIN wv s ON s.symbol = w.symbol AND s.rn = w.rn + 1),
 r0 AS (SELECT b.*, w14.e AS a FROM b LEFT JOIN w14 ON w14.symbol = b.symbol AND w14.rn = b.rn),
 r1 AS (SELECT *, {full(f'regr_intercept(close, rn) {over(20)} + regr_slope(close, rn) {over(20)} * rn', 20)} AS line, {full(f'regr_slope(close, rn) {over(14)}', 14)} AS slope, {sma('low', 2)} AS lo2, {sma('high', 2)} AS hi2, coalesce(ln(close / {lag('high')}), 0) AS dd FROM r0),
 r2 AS (SELECT *, line + a AS ub, line - a AS lb, coalesce(sign(line - {lag('line')}), 0) AS dir, abs(slope) AS aslope FROM r1),
 r3 AS (SELECT *, coalesce(dir - {lag('dir')}, 0) AS turn, (ub - lb) / line AS channel, close - lb AS padding, least(close, open, CASE WHEN open < line THEN low ELSE lo2 END) AS mn, greatest(close, open, CASE WHEN open > line THEN high ELSE hi2 END) AS mx,
   {full(f'median(aslope) {over(20)}', 33)} AS slope_ub, sum(dd) {over(3)} AS dd3, sum(dd) {over(4)} AS dd4 FROM r2),
 r4 AS (SELECT *, coalesce(mn > lb AND {lag('mn')} <= {lag('lb')}, false) AS bj, coalesce(ub > mx AND {lag('ub')} <= {lag('mx')}, false) AS bs, {full(_pct('close', 21), 21)} AS p21, {full(_pct('close', 84), 84)} AS p84, {full(_pct('padding', 21), 40)} AS q21, {full(_pct('padding', 84), 103)} AS q84 FROM r3),
 r5 AS (SELECT *, CASE WHEN p21 < 0.618::DOUBLE THEN (q21 + p21) / 2 ELSE p21 END AS s21, CASE WHEN p84 < 0.618::DOUBLE THEN (q84 + p84) / 2 ELSE p84 END AS s84 FROM r4), r6 AS (SELECT *, sign(s21 - s84) AS boost FROM r5)"""
ORACLES["regression_cross"] = recursive(
    _CROSS,
    f"""SELECT symbol, dt, {R('channel')} AS channel, {R('slope')} AS slope, {R('slope_ub')} AS slope_ub, {R('dd3')} AS drawdown_3, {R('dd4')} AS drawdown_4, {R('s21')} AS score_21, {R('s84')} AS score_84, sign(turn)::BIGINT AS cross_,
 {since('turn > 0')} AS jx_before, {since('turn < 0')} AS sx_before, {since('bj')} AS band_jx_before, {since('bs')} AS band_sx_before, {run('boost > 0')} - ({run('boost < 0')}) AS boost_run FROM r6""",
)


def _ledger_sql(principle: bool) -> str:
    """The trade machine as a recursive table: one row for each bar with the state of the trade that is open or ends there."""
    good = "good" if principle else "true"
    parts = f""", s0 AS (SELECT *, coalesce({sma('close', 5)} > {sma('close', 20)}, false) AS up, coalesce(close > {sma('close', 20)}, false) AS good FROM b), s1 AS (SELECT *, up AND NOT coalesce({lag('up')}, false) AS trig FROM s0),
 s2 AS (SELECT *, coalesce(rn - last_value(CASE WHEN trig THEN rn END IGNORE NULLS) {UPTO}, rn) <= 3 AS live FROM s1),
 m AS (SELECT symbol, rn, -1 AS trade, 0 AS state, false AS open, NULL::BIGINT AS start, NULL::BIGINT AS act, NULL::DOUBLE AS settle, NULL::DOUBLE AS fc, NULL::BIGINT AS fin FROM (SELECT symbol, 0::BIGINT AS rn FROM s2 WHERE rn = 1) UNION ALL
 SELECT symbol, rn, CASE WHEN fresh THEN trade + 1 ELSE trade END, CASE WHEN fresh THEN CASE WHEN good THEN 1 ELSE 2 END WHEN NOT open THEN state WHEN ends THEN CASE WHEN now = 1 THEN 3 ELSE 4 END WHEN stops THEN 4 ELSE now END,
   CASE WHEN fresh THEN true WHEN open THEN NOT ends AND NOT stops ELSE false END, CASE WHEN fresh THEN rn ELSE start END, CASE WHEN fresh THEN CASE WHEN good THEN rn END WHEN open AND act IS NULL AND now = 1 THEN rn ELSE act END,
   CASE WHEN fresh THEN CASE WHEN good THEN close END WHEN open AND act IS NULL AND now = 1 THEN close ELSE settle END,
   CASE WHEN fresh THEN NULL WHEN open AND NOT ends AND NOT live AND now = 1 AND fc IS NULL AND settle IS NOT NULL THEN (close - settle) / settle ELSE fc END, CASE WHEN fresh THEN NULL WHEN open AND (ends OR stops) THEN rn ELSE fin END
 FROM (SELECT *, NOT live AND NOT ends AND now = 2 AS stops FROM (SELECT s.symbol, s.rn, s.close, s.live, {good.replace('good', 's.good')} AS good, m.trade, m.state, m.open, m.start, m.act, m.settle, m.fc, m.fin, NOT m.open AND s.trig AS fresh, NOT s.up AS ends,
     CASE WHEN s.live AND {'true' if principle else 'false'} THEN CASE WHEN m.state = 2 AND {good.replace('good', 's.good')} THEN 1 WHEN m.state = 1 AND NOT {good.replace('good', 's.good')} THEN 2 ELSE m.state END ELSE m.state END AS now
   FROM m JOIN s2 s ON s.symbol = m.symbol AND s.rn = m.rn + 1))),
 l AS (SELECT m.*, z.last FROM m JOIN (SELECT symbol, max(rn) AS last FROM b GROUP BY symbol) z USING (symbol) WHERE trade >= 0 QUALIFY row_number() OVER (PARTITION BY symbol, trade ORDER BY rn DESC) = 1)"""
    return recursive(
        parts,
        """SELECT l.symbol, l.trade::INT AS trade, l.state::INT AS state, x.dt AS start_dt, a.dt AS act_dt, f.dt AS end_dt, 1::INT AS long, l.settle, e.close AS end_price, (e.close - l.settle) / l.settle AS ret, l.fc AS ret_forecast,
 (e.close - x.close) / x.close AS ret_simulated, coalesce(l.fin, l.last) - l.start AS bars FROM l JOIN b x ON x.symbol = l.symbol AND x.rn = l.start JOIN b e ON e.symbol = l.symbol AND e.rn = coalesce(l.fin, l.last)
 LEFT JOIN b a ON a.symbol = l.symbol AND a.rn = l.act LEFT JOIN b f ON f.symbol = l.symbol AND f.rn = l.fin""",
    )


ORACLES["trade_ledger"], ORACLES["trade_ledger_plain"] = _ledger_sql(True), _ledger_sql(False)


@query(recursive(_rsi_of(60) + f", ra AS (SELECT *, avg(r60) {over(5)} - coalesce(CASE WHEN count(r60) {over(60)} = 60 THEN avg(r60) {over(60)} END, 50) AS apart FROM rs)", f"SELECT symbol, dt, greatest(0::DOUBLE, 100 - round(tan(radians(apart)) * 50 + 1e-7::DOUBLE, 0)) AS ratio FROM ra"))
def rsi_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import allocation

    df = W.numbered(I.rsi_frame(day_bars(spark, sf_dir), (60,))).withColumn("rsi", F.col("rsi_60"))
    return allocation.rsi_ratio(df).select("symbol", "dt", "ratio")


_GATE = "WITH l AS (SELECT event_type AS symbol, max(ts) AS last FROM events GROUP BY 1), n AS (SELECT unnest([TIMESTAMP '2024-01-31 09:00:00', TIMESTAMP '2024-01-31 09:30:00', TIMESTAMP '2024-02-02 08:00:00']) AS now)"
_AGE = "(floor(epoch(now)) - floor(epoch(last))) / 3600"


@query(f"{_GATE} SELECT symbol, now AS now_, CASE WHEN strftime(now, '%H:%M') > '09:15' THEN {_AGE} > 10 ELSE {_AGE} > 40 END AS day_gate, CASE WHEN strftime(now, '%H:%M') > '09:15' THEN {_AGE} > 10 ELSE {_AGE} > 24 END AS minute_gate FROM l, n")
def realtime_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether day and minute bars ask for realtime rows, at three times of day."""
    last = B.ticks(spark, sf_dir).groupBy("symbol").agg(F.max("dt").alias("last"))
    now = F.explode(F.array(*[F.lit(x).cast("timestamp_ntz") for x in ("2024-01-31 09:00:00", "2024-01-31 09:30:00", "2024-02-02 08:00:00")]))
    df = last.withColumn("now_", now)
    return df.select("symbol", "now_", B.needs_realtime(F.col("last"), F.col("now_")).alias("day_gate"), B.needs_realtime(F.col("last"), F.col("now_"), True).alias("minute_gate"))


@query("""WITH d AS (SELECT l_suppkey AS symbol, max(l_shipdate) AS last FROM lineitem GROUP BY 1), n AS (SELECT unnest(range(DATE '2001-09-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS now) SELECT symbol, now AS now_, date_diff('day', last, now) >= 30 AND isodow(now) = 1 AS may FROM d, n""")
def rebalance_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On which days a fund may trade again."""
    from ..operators import allocation

    last = day_bars(spark, sf_dir).groupBy("symbol").agg(F.max("dt").alias("last"))
    days = F.explode(F.sequence(F.lit("2001-09-01").cast("timestamp_ntz"), F.lit("2001-12-30").cast("timestamp_ntz"), F.expr("interval 1 day")))
    return last.withColumn("now_", days).select("symbol", "now_", allocation.may_rebalance(F.col("last"), F.col("now_")).alias("may"))
