"""Queries of learning kernels, back-tests, allocation, market votes and streaming."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import window as W
from ..operators import allocation, backtest, indicators, market, ml
from ..sources import bars as B
from ..sources.bars import day_bars
from ..streaming import bars as streaming
from .oracle import UPTO, full, over, sma, with_bars
from .oracle import W as OW
from .q_indicators import pick
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


@query()
def renko_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(ml.renko_frame(day_bars(spark, sf_dir)), {"s_level": 4, "l_level": 4, "brick": 4}, ("s_bricks", "l_bricks", "trend", "s_run", "l_run", "run"))


@query()
def lis_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.waves(day_bars(spark, sf_dir)).select("symbol", "dt", "wave")


@query()
def model_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(ml.tree_frame(day_bars(spark, sf_dir)), {"tree_price": 3, "tree_slope": 4}, ("tree_trend", "tree_age"))


@query()
def eemd_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.best_turns(ml.bar_mode_turns(day_bars(spark, sf_dir), most=17))


@query(with_bars(f""", m AS (SELECT symbol, avg(rn) AS mx, avg(close) AS my FROM b GROUP BY symbol), p AS (SELECT b.symbol, mx, my, rn - mx AS u, close - my AS v FROM b JOIN m USING (symbol)),
 s AS (SELECT symbol, first(mx) AS mx, first(my) AS my, sum(u*u) AS uu, sum(v*v) AS vv, sum(u*v) AS uv, sum(u*(u*u+v*v)) AS uz, sum(v*(u*u+v*v)) AS vz, count(*) AS n FROM p GROUP BY symbol),
 c AS (SELECT *, (uz*vv - vz*uv) / (2*(uu*vv - uv*uv)) AS a, (vz*uu - uz*uv) / (2*(uu*vv - uv*uv)) AS bb FROM s)
 SELECT symbol, {R('a + mx', 0)} AS cx, {R('bb + my', 1)} AS cy, {R('sqrt(a*a + bb*bb + (uu+vv)/n)', 0)} AS radius FROM c"""))
def circle_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ml.circle(numbered(spark, sf_dir), "symbol", "rn", "close")
    return c.select("symbol", r(F.col("cx"), 0).alias("cx"), r(F.col("cy"), 1).alias("cy"), r(F.col("radius"), 0).alias("radius"))


@query()
def gmm_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = numbered(spark, sf_dir).withColumns({"ret": W.pct_change("close"), "lo": F.min("low").over(W.w().rowsBetween(-30, 29)), "hi": F.max("high").over(W.w().rowsBetween(-30, 29))})
    df = df.withColumn("place", (F.col("close") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    return ml.slices(ml.clusters(df, ["ret", "place"]), "cluster").select("symbol", "dt", "cluster", F.col("slice").cast("bigint").alias("slice"))


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = numbered(spark, sf_dir).withColumns({"ma5": W.sma("close", 5), "ma20": W.sma("close", 20)})
    up = F.coalesce(F.col("ma5") > F.col("ma20"), F.lit(False))
    df = df.withColumn("position", up.cast("int"))
    entered = (F.col("position") == 1) & (F.coalesce(W.lag("position"), F.lit(0)) == 0)
    df = df.withColumns({"trigger": entered.cast("int"), "principle": F.when(F.col("close") > F.col("ma20"), 1).otherwise(-1)})
    age = W.bars_since(F.col("trigger") == 1)
    return df.withColumn("forecast", (age <= backtest.HORIZON[252]).cast("int"))


@query()
def trade_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.ledger(_signals(spark, sf_dir), "trigger", "forecast", "position", "principle")


@query()
def trade_ledger_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.ledger(_signals(spark, sf_dir), "trigger", "forecast", "position")


@query(with_bars(RET + f""", l AS (SELECT *, ln(1 + coalesce(ret, 0)) AS l FROM r), c AS (SELECT *, sum(l) {UPTO} AS c FROM l), p AS (SELECT *, greatest(max(c) {UPTO}, 0) AS p FROM c)
 SELECT symbol, dt, {R(full(f"exp(sum(l) {over(60)}) - 1", 60))} AS annual, {R(full(f"(avg(ret) {over(60)} - 0.02::DOUBLE / 252) / nullif(stddev_samp(ret) {over(60)}, 0) * sqrt(252)", 60))} AS sharpe, {R('exp(c - p) - 1')} AS drawdown FROM p"""))
def strategy_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(backtest.performance(returns(spark, sf_dir), "ret", 60), {"annual": 4, "sharpe": 4, "drawdown": 4})


@query()
def markowitz(spark: SparkSession, sf_dir: str) -> DataFrame:
    ret = returns(spark, sf_dir).where("ret is not null").select("dt", "symbol", "ret")
    rows = sorted((int(s), round(float(a), 4), round(float(b), 4)) for s, a, b in zip(*allocation.portfolios(ret)))
    return spark.createDataFrame(rows, "symbol long, min_variance double, max_sharpe double")


@query()
def es_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.relational import expected_shortfall

    es = expected_shortfall(returns(spark, sf_dir)).select("symbol", "es", (F.col("symbol") % 5).alias("growth"), F.lit(1.0).alias("weight"), F.lit(None).cast("double").alias("last"))
    return allocation.es_allocation(es).select("symbol", r(F.col("score")).alias("score"), r(F.col("ratio")).alias("ratio"))


@query()
def rsi_atr_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import kernels as K

    df = W.numbered(indicators.with_kernel(day_bars(spark, sf_dir), ["high", "low", "close"], "rsi double, atr double", lambda h, low, c: {"rsi": K.rsi(c, 7), "atr": K.atr(h, low, c, 21)}))
    return allocation.rsi_atr_check(df).select("symbol", "dt", "check")


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for the stored features, made from bars: each column is a documented function of returns and averages."""
    f = indicators.ma_system(day_bars(spark, sf_dir)).withColumn("ret", F.coalesce(W.pct_change("close"), F.lit(0.0)))
    up, above, strong = F.signum("ret"), F.signum(F.coalesce(F.col("close") - F.col("ma20"), F.lit(0.0))), F.signum(F.coalesce(F.col("ma5") - F.col("ma60"), F.lit(0.0)))
    made = {
        "FLU_POSITIVE": (up > 0).cast("int"), "ML_FLU_TREND": above.cast("int"), "VOLUME_FLOW_BOOST": (F.col("volume") > 30).cast("int") * up.cast("int"),
        "ATR_Stopline": above.cast("int"), "ATR_SuperTrend": strong.cast("int"), "MAXFACTOR_CROSS": F.col("cross_5_10").cast("int"), "DUAL_CROSS": up.cast("int"),
        "TALIB_PATTERNS": (F.col("close") - F.col("open") > 0).cast("int"), "ADXm_Trend": strong.cast("int"), "Volume_HMA5": above.cast("int"),
        "BOOTSTRAP_I": (F.col("jx_5_10") == 0).cast("int"), "DEADPOOL": (F.col("sx_5_10") == 0).cast("int"), "FLU_POSITIVE_MASTER": (above > 0).cast("int"),
        "FLU_NEGATIVE_MASTER": (above < 0).cast("int"), "VOLUME_FLOW_BOOST_BONUS": (F.col("volume") > 45).cast("int"), "PEAK_OPEN": F.col("ret") / 100,
        "DEA_NORM": F.col("ma5") / F.col("ma60") - 1, "MACD_NORM": F.col("ma5") / F.col("ma20") - 1, "MACD_DELTA_NORM": F.col("ma5") / F.col("ma10") - 1, "BOLL_RENKO": above,
        "BOOTSTRAP_GROUND_ZERO": strong, "BOLL_RENKO_MINOR": up, "BOOTSTRAP_GROUND_ZERO_MINOR": F.signum(F.coalesce(F.col("ma5") - F.col("ma10"), F.lit(0.0))) - 0.5, "CLUSTER_GROUP_TOWARDS": up.cast("int"),
    }
    from ..operators.relational import breadth

    return breadth(f.select("dt", *[c.alias(k) for k, c in made.items()]))


@query()
def market_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = market.market_vote(_market(spark, sf_dir))
    return v.select("dt", F.col("total").cast("bigint").alias("total"), *[F.col(c).cast("bigint").alias(c) for c in ("missive_dif", "massive_trend", "master_stream", "massive_flu")])


@query(with_bars(f""", f AS (SELECT *, close / lag(close) {OW} - 1 AS ret, {sma('close', 20)} AS ma20, {sma('close', 60)} AS ma60 FROM b),
 d AS (SELECT dt, count(*)::BIGINT AS n, avg((close > ma20)::INT) AS above, median(ret) AS p1, median(ma20 / ma60 - 1) AS p2 FROM f GROUP BY dt),
 u AS (SELECT *, coalesce((p1 > 0)::INT, 0) + coalesce((p2 > 0)::INT, 0) = 2 AS up, coalesce(above > 0.5, false) AS ov FROM d), l AS (SELECT *, up AND ov AS full_, coalesce(lag(up AND ov) OVER (ORDER BY dt), false) AS before FROM u)
 SELECT dt, n, {R('above')} AS above, (CASE WHEN full_ THEN 1 WHEN before AND (up OR ov) THEN 2 WHEN before THEN 3 ELSE 0 END)::BIGINT AS trend FROM l"""))
def mass_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = returns(spark, sf_dir).withColumns({"ma20": W.sma("close", 20), "ma60": W.sma("close", 60)}).withColumn("power", F.col("ma20") / F.col("ma60") - 1)
    return market.mass_trend(f, ["ret", "power"], "ma20").select("dt", "n", r(F.col("above")).alias("above"), F.col("trend").cast("bigint").alias("trend"))


@query("SELECT * FROM (SELECT event_type AS symbol, time_bucket(INTERVAL 60 MINUTE, ts) + INTERVAL 60 MINUTE AS dt, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::BIGINT AS volume FROM events GROUP BY 1, 2) WHERE dt <= (SELECT max(ts) FROM events)")
def stream_bars_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the event stream by a watermarked streaming query, read back: windows that the stream has passed."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='ohlcraft-stream-')}"
    folder = f"{base.rstrip('/')}/stream-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    static = B.table(spark, sf_dir, "events")
    raw = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/events.parquet*")
    ticks = raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("dt"), F.col("value").alias("price"), F.lit(1).alias("vol"))
    bars = streaming.stream_bars(ticks, "60 minutes").drop("window")
    done = bars.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/bars").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{folder}/bars").select("symbol", F.col("dt").cast("timestamp_ntz").alias("dt"), "open", "high", "low", "close", F.col("volume").cast("bigint").alias("volume"))


@query("SELECT event_type AS symbol, time_bucket(INTERVAL 60 MINUTE, ts) + INTERVAL 60 MINUTE AS dt, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::BIGINT AS volume FROM events GROUP BY 1, 2")
def batch_bars_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = B.ticks(spark, sf_dir).withColumn("dt", F.col("dt").cast("timestamp"))
    b = t.groupBy("symbol", F.window("dt", "60 minutes").alias("w")).agg(F.min_by("price", "dt").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "dt").alias("close"), F.count("*").alias("volume"))
    return b.select("symbol", F.col("w.end").cast("timestamp_ntz").alias("dt"), "open", "high", "low", "close", "volume")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g) SELECT user_id, min(ts) AS start_, count(*)::BIGINT AS n FROM s GROUP BY user_id, sid")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = B.table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    s = ev.groupBy("user_id", F.session_window("t", "6 hours").alias("w")).agg(F.min("ts").alias("start_"), F.count("*").alias("n"))
    return s.select("user_id", "start_", "n")


@query("WITH l AS (SELECT event_type AS symbol, max(ts) AS dt FROM events GROUP BY 1) SELECT symbol, dt, (epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(dt)))::BIGINT AS age FROM l WHERE epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(dt) > 180")
def stale_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streaming.stale(B.ticks(spark, sf_dir), "2024-02-01 00:00:00", 60).select("symbol", "dt", F.col("age").cast("bigint").alias("age"))


@query()
def regression_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.features import regression_cross as cross

    floats = {c: 4 for c in ("channel", "slope", "slope_ub", "drawdown_3", "drawdown_4", "score_21", "score_84")}
    df = cross(day_bars(spark, sf_dir)).withColumnRenamed("cross", "cross_")
    return pick(df, floats, ("cross_", "jx_before", "sx_before", "band_jx_before", "band_sx_before", "boost_run"))


@query(with_bars(f", a AS (SELECT *, {sma('close', 5)} AS ma5, {sma('close', 20)} AS ma20 FROM b), f AS (SELECT *, coalesce(ma5 < ma20, false) AS f FROM a), g AS (SELECT *, f AND NOT coalesce(lag(f) {OW}, false) AS n FROM f) SELECT symbol, sum(n::INT)::BIGINT AS crossings FROM g GROUP BY symbol"))
def crossings_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.features import crossings_down as down

    return down(numbered(spark, sf_dir).withColumns({"ma5": W.sma("close", 5), "ma20": W.sma("close", 20)}), "ma5", "ma20")


@query(with_bars(f", p AS (SELECT symbol, max(rn) // 2 AS rn FROM b GROUP BY symbol) SELECT symbol, rn::BIGINT AS rn, dt, {R('close')} AS close FROM p JOIN b USING (symbol, rn)"))
def gather_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.features import at_rows

    b = day_bars(spark, sf_dir)
    places = b.groupBy("symbol").agg(F.floor(F.count("*") / 2).cast("bigint").alias("rn"))
    return at_rows(b, places, ["dt", "close"]).select("symbol", "rn", "dt", r(F.col("close")).alias("close"))


@query(with_bars(f", f AS (SELECT symbol, dt, (close > open)::INT AS buy, (close < open * 0.9::DOUBLE)::INT AS sell, rn FROM b), s AS (SELECT *, rn - coalesce(last_value(CASE WHEN buy = 1 THEN rn END IGNORE NULLS) {UPTO}, 0) AS bs, rn - coalesce(last_value(CASE WHEN sell = 1 THEN rn END IGNORE NULLS) {UPTO}, 0) AS ss FROM f) SELECT symbol, dt, (bs < ss)::BIGINT AS held FROM s"))
def onhold_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = numbered(spark, sf_dir).withColumns({"buy": F.col("close") > F.col("open"), "sell": F.col("close") < F.col("open") * 0.9})
    return backtest.onhold_position(df, "buy", "sell", "held").select("symbol", "dt", "held")


@query(with_bars(RET + f""", l AS (SELECT *, ln(1 + coalesce(ret, 0)) AS l FROM r), c AS (SELECT *, sum(l) {UPTO} AS c FROM l), p AS (SELECT *, greatest(max(c) {UPTO}, 0) AS p FROM c) SELECT symbol, {R('min(exp(c - p) - 1)')} AS max_drawdown FROM p GROUP BY symbol"""))
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.max_drawdown(returns(spark, sf_dir), "ret").select("symbol", r(F.col("max_drawdown")).alias("max_drawdown"))


def _checked() -> str:
    from .q_indicators import _rsi_of, recursive, wilder

    tr = f", t_ AS (SELECT *, greatest(high - low, abs(high - lag(close) {OW}), abs(low - lag(close) {OW})) AS x0 FROM b), tr_ AS (SELECT symbol, dt, rn, x0 AS x FROM t_ WHERE rn > 1)" + wilder("tr_", 21, "w21_", 2)
    parts = _rsi_of(7) + tr + f", v AS (SELECT rs.*, w21_.e AS atr FROM rs LEFT JOIN w21_ ON w21_.symbol = rs.symbol AND w21_.rn = rs.rn), m AS (SELECT *, {sma('r7', 14)} AS mean, {full(f'stddev_pop(r7) {over(14)}', 14)} AS sd, close - lag(close) {OW} AS jump FROM v)"
    return recursive(parts, "SELECT symbol, dt, (CASE WHEN r7 > least(mean + 1.4::DOUBLE * sd, 70) OR jump < -3 * atr THEN -1 WHEN r7 < greatest(mean - 1.4::DOUBLE * sd, 30) THEN 1 ELSE 0 END)::BIGINT AS check FROM m")


ORACLES["rsi_atr_check"] = _checked().replace(" AS check FROM m", " AS \"check\" FROM m")


def _vote_sql() -> str:
    """market_vote as SQL, over the same stand-ins."""
    from .oracle import since

    mas = ", ".join(f"{sma('close', n)} AS ma{n}" for n in (5, 10, 20, 60))
    up = f"(ma5 > ma10 AND lag(ma5) {OW} <= lag(ma10) {OW})"
    down = f"(ma10 > ma5 AND lag(ma10) {OW} <= lag(ma5) {OW})"
    rows = f""", a AS (SELECT *, {mas}, coalesce(close / lag(close) {OW} - 1, 0) AS ret FROM b), c AS (SELECT *, coalesce({up}, false) AS u, coalesce({down}, false) AS d FROM a),
 e AS (SELECT dt, volume, close > open AS white, sign(ret) AS up, sign(coalesce(close - ma20, 0)) AS ab, sign(coalesce(ma5 - ma60, 0)) AS st, ret / 100 AS po, ma5 / ma60 - 1 AS n1, ma5 / ma20 - 1 AS n2, ma5 / ma10 - 1 AS n3, sign(coalesce(ma5 - ma10, 0)) AS c5, CASE WHEN u THEN 1 WHEN d THEN -1 ELSE 0 END AS cr, {since('u')} AS jx, {since('d')} AS sx FROM c),
 m AS (SELECT dt, count(*) AS total, sum((up > 0)::INT) AS flu, sum(ab) AS ml, sum((volume > 30)::INT * up) AS vol, sum(ab) AS atr1, sum(st) AS atr2, sum(cr) AS maxf, sum(up) AS dual, sum(white::INT) AS pat, sum(st) AS adx,
   sum(ab) AS vhma, sum((jx = 0)::INT) AS boot, sum((sx = 0)::INT) AS dead, sum((ab > 0)::INT) AS master, sum((volume > 45)::INT) AS bonus,
   avg(po) AS po, avg(n1) AS dea, avg(n2) AS macd, avg(n3) AS delta, sum(up) AS crowd, sum(CASE WHEN ab >= 0 THEN 1 ELSE -1 END) AS br, sum(CASE WHEN st >= 0 THEN 1 ELSE -1 END) AS bg, sum(CASE WHEN up >= 0 THEN 1 ELSE -1 END) AS brm, sum(CASE WHEN c5 > 0 THEN 1 ELSE -1 END) AS bgm FROM e GROUP BY dt),
 r1 AS (SELECT *, flu / total AS fr, master / total AS mr FROM m)"""
    lag = "OVER (ORDER BY dt)"
    d = lambda c: f"({c} - lag({c}) {lag})"
    rises = " + ".join(f"coalesce(sign({d(c)}), 0)" for c in ("fr", "mr", "vol", "bonus", "boot", "pat", "flu", "ml", "adx", "vhma"))
    falls = " - ".join(f"coalesce(sign({d(c)}), 0)" for c in ("maxf", "dual", "dead"))
    rows += f", r2 AS (SELECT *, coalesce({d('vol')} + {d('bonus')}, 0) AS vfb, coalesce({d('atr1')} + {d('atr2')}, 0) AS atr, {rises} - {falls} AS dif, coalesce({d('maxf')}, 0) AS dmax, coalesce({d('vol')}, 0) AS dvfb FROM r1)"
    rows += f", r3 AS (SELECT *, coalesce(lag(dif) {lag}, 0) AS ldif, coalesce(lag(vfb) {lag}, 0) AS lvfb FROM r2)"
    weak = "(maxf < 0 OR ldif < 0 OR dmax / total < -0.168::DOUBLE)"

    def cascade(source: str, to: str, ratio: str, flu: str, ml: str, out: str) -> str:
        q = lambda p: f"quantile_cont({ratio}, {p}) OVER ()"
        four = "OVER (ORDER BY dt ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
        pct = lambda c: f"{c} / nullif(lag({c}) {lag}, 0)::DOUBLE - 1"
        return f""", {to}0 AS (SELECT *, {q(0.382)} AS q382, {q(0.618)} AS q618, {q(0.809)} AS q809, median({ml}) OVER () AS med, avg({ratio}) {four} AS m4r, avg({ml}) {four} AS m4l,
   lag({flu}) {lag} AS lflu, lag({ml}) {lag} AS lml, {pct(flu)} AS pflu, {pct(ml)} AS pml FROM {source}),
 {to} AS (SELECT * EXCLUDE (q382, q618, q809, med, m4r, m4l, lflu, lml, pflu, pml), CASE WHEN {ratio} < greatest(0.382::DOUBLE, q382) AND atr < 0 THEN -1 WHEN vfb / total < -0.168::DOUBLE THEN -2 WHEN dvfb < 0 AND vol < 0 AND {weak} THEN -3
   WHEN vfb / total > 0.309::DOUBLE THEN 1 WHEN (vfb + lvfb) / total > 0.309::DOUBLE AND vfb / total > 0.168::DOUBLE THEN 2 WHEN (vol + bonus) / total > 0.0618::DOUBLE AND vol > 0 AND vfb > 0 THEN 3
   WHEN {ratio} < greatest(0.512::DOUBLE, q618) AND m4r < greatest(0.512::DOUBLE, q618) AND m4l < 0 AND {ml} < med AND {weak} THEN -4 WHEN {ratio} < q382 AND {weak} THEN -5 WHEN {ratio} > q809 AND {ml} > med THEN 4
   WHEN {flu} <= lflu AND {ml} < lml AND {weak} THEN -6 WHEN pflu < 0 AND pml < 0 THEN -7 WHEN pflu > 0 AND dif > 0 AND vol > 0 THEN 5 WHEN pml > 0 AND dif > 0 AND vol > 0 THEN 6 WHEN vol < 0 THEN -8
   WHEN dif > 0 THEN 9 WHEN dif < 0 AND {weak} THEN -9 WHEN dmax < 0 AND (ldif < 0 OR dif < 0) THEN -11 ELSE 0 END AS {out} FROM {to}0)"""

    rows += cascade("r3", "r4", "fr", "flu", "ml", "mt") + cascade("r4", "r5", "mr", "master", "mt", "ms")
    rows += f""", s0 AS (SELECT *, lag(maxf) {lag} AS maxf1, lag(dual) {lag} AS dual1, lag(delta) {lag} AS delta1, lag(delta, 2) {lag} AS delta2, lag(mt, 2) {lag} AS mt2, lag(po) {lag} + lag(po, 2) {lag} + lag(po, 3) {lag} + lag(po, 4) {lag} AS po4,
   CASE WHEN row_number() {lag} >= 21 THEN len(list_filter(list(po) OVER (ORDER BY dt ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), lambda x: x <= po)) / 21 END AS rank FROM r5),
 v0 AS (SELECT *, CASE WHEN CASE WHEN mt = 0 THEN ms < 0 ELSE ms / mt::DOUBLE < 0.0002 END THEN CASE WHEN dif > 0 THEN 10 WHEN dif < 0 THEN CASE WHEN maxf > 0 AND maxf1 > 0 THEN 12 ELSE -10 END ELSE 0 END ELSE mt END AS v,
   coalesce(delta < 0, false) OR coalesce(delta1 < 0 AND maxf1 < 0, false) AS fades FROM s0)"""
    steps = (
        (13, "v = -4 AND maxf > 0 AND maxf1 > 0 AND mt2 > 0 AND (maxf - maxf1 > 0 OR dif > 0)"),
        (-99, "v1 < 0 AND v2 > 0 AND maxf < 0 AND maxf1 < 0 AND dual1 > dual"),
        (11, "v <= 0 AND (coalesce(v1 > 0, false) OR coalesce(maxf / total > 0.809 AND maxf1 / total > 0.809, false) OR coalesce(v2 > 0 AND maxf / total > 0.809, false)) AND dea > 0 AND delta > 0 AND maxf > 0 AND (maxf / total > 0.618 OR bgm > 0)"),
        (12, "v <= 0 AND (coalesce(v1 > 0, false) OR coalesce(macd > 0, false)) AND v2 > 0 AND delta1 > 0 AND delta2 > 0 AND dea > 0 AND delta > 0 AND maxf > 0 AND dual > 0 AND crowd < 0"),
        (-98, "v >= 0 AND maxf < 0 AND dual < 0 AND fades AND macd < 0 AND ((br < 0 AND bg < 0) OR (brm < 0 AND bgm < 0))"),
        (-97, "v >= 0 AND maxf < 0 AND fades AND (dual < 0 OR coalesce(macd < 0, false)) AND br < 0 AND bg < 0 AND brm < 0 AND bgm < 0"),
        (13, "v <= 0 AND po4 > 0 AND po < -0.0168::DOUBLE AND dea > 0 AND rank < 0.1236 AND crowd / total > 0.168"),
    )
    for k, (code, holds) in enumerate(steps):
        rows += f", u{k} AS (SELECT *, lag(v) {lag} AS v1, lag(v, 2) {lag} AS v2 FROM v{k}), v{k + 1} AS (SELECT * EXCLUDE (v, v1, v2), CASE WHEN coalesce({holds}, false) THEN {code} ELSE v END AS v FROM u{k})"
    rows += " SELECT dt, total::BIGINT AS total, dif::BIGINT AS missive_dif, mt::BIGINT AS massive_trend, ms::BIGINT AS master_stream, v::BIGINT AS massive_flu FROM v7"
    return with_bars(rows)


ORACLES["market_vote"] = _vote_sql()
