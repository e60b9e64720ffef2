"""Queries of the rule catalogues. Their inputs are feature columns over the bars: MACD, averages, bands, RSI, MAXFACTOR, dual
cross, ages and clearances as defined by the indicators; columns that need other data than bars (model trees, group trends, wavelet
points, brick directions) are given by the plain window expressions below, the same for the query and for its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import window as W
from ..operators import indicators as I
from ..operators import backtest, rules
from ..sources.bars import day_bars
from .oracle import UPTO, P, full, over, run, since, sma
from .oracle import W as OW
from .q_indicators import MACD, pick, recursive
from .q_more import FACTORS, lag
from .q_window import R, r

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named inputs of the rules, one row for each bar."""
    df = I.maxfactor_cross(I.macd_frame(day_bars(spark, sf_dir)))
    df = df.withColumns({f"ma{n}": W.sma("close", n) for n in (5, 10, 30, 90, 120)} | {"boll": W.sma("close", 20), "__sd": W.rolling(F.stddev_pop, "close", 20)})
    slope, inter = (W.full(f(F.col("close"), F.col("rn")).over(W.frame(20)), 20) for f in (F.regr_slope, F.regr_intercept))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - W.lag("close")), F.abs(F.col("low") - W.lag("close")))
    df = df.withColumns({
        "boll_ub": F.col("boll") + 2 * F.col("__sd"), "boll_lb": F.col("boll") - 2 * F.col("__sd"), "line": inter + slope * F.col("rn"), "__tr": tr,
        "pct": W.pct_change("close"), "rsi_delta": W.delta("rsi"), "macd_delta": W.delta("macd"), "dif_1": W.lag("dif"),
        "macd_jx": W.bars_since((F.col("macd") > 0) & (W.lag("macd") <= 0)), "macd_sx": W.bars_since((F.col("macd") < 0) & (W.lag("macd") >= 0)),
        "zen_jx": W.bars_since(W.crossed("close", "ma10")), "zen_sx": W.bars_since(W.crossed("ma10", "close")),
        "renko_s": F.signum(W.delta("close", 4)), "renko_l": F.signum(W.delta("close", 10)), "density": F.avg((F.col("close") > F.col("open")).cast("int")).over(W.frame(21)),
        "z21": W.pct_rank("close", 21), "dea_slope": W.ols_slope("dea", 14), "higher_settle": (F.col("dea") > 0) & (F.col("macd") > F.col("dea")),
        "flow_tri": F.signum(F.avg("volume").over(W.frame(5)) - F.avg("volume").over(W.frame(10))), "factor": F.col("state"), "dual_jx": W.run_length(F.col("dual") > 0),
    })
    df = df.withColumns({
        "atr_lb": F.col("line") - F.avg("__tr").over(W.frame(14)), "boll_channel": (F.col("boll_ub") - F.col("boll_lb")) / F.col("boll"), "boll_ub_1": W.lag("boll_ub"), "ma30_1": W.lag("ma30"),
        "line_1": W.lag("line"), "z21_1": W.lag("z21"), "lr_dir": F.signum(W.delta("line")), "clear90": (F.col("boll_ub") - F.col("ma90")) / F.nullif(F.col("boll_ub") - F.col("boll_lb"), F.lit(0.0)),
        "density_sma": F.avg("density").over(W.frame(21)), "tide_sx": W.run_length(F.col("density") < W.lag("density")), "boll_jx": W.bars_since(W.crossed("close", "boll_lb")),
        "boll_sx": W.bars_since(W.crossed("boll_ub", "close")), "renko": F.when(F.col("renko_s") == F.col("renko_l"), F.col("renko_s")).otherwise(0.0),
    })
    turn = F.col("lr_dir") - W.lag("lr_dir")
    df = df.withColumns({"boll_delta": W.delta("boll_channel"), "lr_jx": W.bars_since(turn > 0), "lr_sx": W.bars_since(turn < 0), "lr_cross": F.signum(turn), "combo": F.signum(F.round(F.col("density") - F.col("density_sma"), 9))})
    above, alike = F.signum(F.col("close") - F.col("boll")), F.col("ma30") > F.col("ma90")
    return df.withColumns({
        "atr_stop": above, "supertrend": F.signum(F.col("close") - F.col("ma30")), "vhma_dir": F.signum(F.col("ma5") - F.col("ma10")), "ml_trend": above, "cluster": F.col("renko"),
        "patterns": F.signum(F.col("close") - F.col("open")), "bootstrap_1": F.col("macd_jx") == 0, "bootstrap_2": F.col("zen_jx") == 0, "deadpool": F.col("macd_sx") == 0,
        "tri_jx": W.run_length(F.col("flow_tri") > 0), "tri_sx": W.run_length(F.col("flow_tri") < 0), "boost": F.col("flow_tri"), "bonus": F.col("volume") > 60, "flu_up": (above > 0).cast("int"),
        "flu_down": (above < 0).cast("int"), "master_up": alike.cast("int"), "master_down": (~alike).cast("int"), "boot_before": F.col("zen_jx"),
        "fullstack_lag": W.signed_run(F.when((F.col("ma5") > F.col("ma30")) & (F.col("ma30") > F.col("ma90")), 1).otherwise(-1)), "halfstack_lag": W.signed_run(F.signum(F.col("ma5") - F.col("ma30"))),
        "downrisk_lag": W.signed_run(F.signum(F.col("ma10") - F.col("ma30"))), "regtree_lag": W.signed_run(F.signum(F.col("close") - F.col("ma90"))), "hma10": F.col("ma10") / 100,
        "ground_zero_lag": W.signed_run(F.signum("dea")), "ground_zero": F.col("dea") > 0, "dash_returns": F.col("pct"), "combo_lag": W.signed_run(F.col("combo")),
    })


def more_features(df: DataFrame) -> DataFrame:
    """What the screens read beside the other inputs."""
    return df.withColumns({
        "poly9_empirical": F.col("line") - F.col("boll"), "dash_lag": W.signed_run(F.col("renko_s")), "macd_zero_lag": W.signed_run(F.signum("macd")), "drawdown_ratio": F.col("density"), "drawdown_ratio_major": F.col("density_sma"),
        "endpoints": F.col("dual"), "endpoints_before": F.col("boll_sx"), "mapower30_lag_major": W.signed_run(F.signum(F.col("ma30") - F.col("ma90"))), "hmapower120_lag_major": W.signed_run(F.signum(F.col("ma90") - F.col("ma120"))),
        "poly9_checkout_atr_lb": F.col("boll_lb"), "mapower30_checkout_atr_lb": F.col("ma120"), "peak_lag": F.col("boll_jx"), "mapower30_low_before": F.col("zen_sx"), "boll_lb_hma5_lag": F.col("boll_sx"), "poly9_checkout_lag": F.col("combo_lag"),
    })


def strength_features(df: DataFrame) -> DataFrame:
    """What the strength rules read beside the other inputs: BIAS of 30 and its rank, longer ranks and slopes, ages of DEA; the
    upper brick and the regression-strength signals are given by plain expressions."""
    df = rules.macd_trend(df)
    df = df.withColumns({"bias3": 100 * (F.col("close") - F.col("ma30")) / F.col("ma30"), "z84": W.pct_rank("close", 84), "dea_jx": W.bars_since((F.col("dea") > 0) & (W.lag("dea") <= 0)), "renko_ub": F.max("high").over(W.frame(4)), "low3": F.min("close").over(W.frame(3)),
        "slope": W.ols_slope("close", 14), **{f"ma{n}_slope": F.when(F.col("rn") >= n + 13, F.regr_slope(f"ma{n}", "rn").over(W.frame(14))) for n in (30, 90, 120)}, "density_8": F.avg("density").over(W.frame(8)), "z21_8": F.avg("z21").over(W.frame(8)), "z21_4": F.avg("z21").over(W.frame(4)),
        "renko_before": W.bars_since(F.col("renko_s") > 0), "renko_sx": W.bars_since(F.col("renko_s") < 0)})
    return df.withColumns({"bias3_z": W.pct_rank("bias3", 21), "sx_dea": W.last_at(F.col("boll_sx") == 0, "dea"), "neg_lower": (F.col("macd") < 0) & (F.col("dea") < 0) & (F.col("macd") < F.col("dea")), "lower_settle": (F.col("dea") < 0) & (F.col("macd_delta") > 0),
        "clear120": (F.col("boll_ub") - F.col("ma120")) / F.nullif(F.col("boll_ub") - F.col("boll_lb"), F.lit(0.0)), "factor_jx": F.col("up_before"), "factor_sx": F.col("down_before"), "boot2_before": F.col("macd_jx"), "rsrs": F.col("flow_tri"), "rsrs_held": F.col("vhma_dir"), "atr_cross": F.col("lr_dir"), "baseline_slope": F.lit(0.001)})


def _signed(x: str) -> str:
    return f"{run(f'({x}) > 0')} - ({run(f'({x}) < 0')})"


_INPUTS = (
    FACTORS
    + MACD.replace("e AS (", "em AS (").replace("FROM e)", "FROM em)").replace("f AS (", "fm AS (").replace("FROM f)", "FROM fm)").replace(", m AS (", ", mc AS (")
    + f""", i0 AS (SELECT mc.*, mz.state AS factor, mz.dual, mz.rsi, mz.maxfactor, mz.up AS f_up, mz.down AS f_down, {", ".join(f"{full(f'avg(mc.close) OVER (PARTITION BY mc.symbol ORDER BY mc.dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)', n).replace('rn >=', 'mc.rn >=')} AS ma{n}" for n in (5, 10, 30, 90, 120))} FROM mc JOIN mz ON mz.symbol = mc.symbol AND mz.rn = mc.rn),
 ia AS (SELECT *, {sma('close', 20)} AS boll, {full(f'stddev_pop(close) {over(20)}', 20)} AS sd, {full(f'regr_intercept(close, rn) {over(20)} + regr_slope(close, rn) {over(20)} * rn', 20)} AS line, {lag('close')} AS c1, {lag('ma10')} AS ma10_1, {lag('macd')} AS macd_1,
   avg((close > open)::INT) {over(21)} AS density, sign(close - {lag('close', 4)}) AS renko_s, sign(close - {lag('close', 10)}) AS renko_l, rsi - {lag('rsi')} AS rsi_delta, {lag('dif')} AS dif_1, {lag('ma30')} AS ma30_1, sign(avg(volume) {over(5)} - avg(volume) {over(10)}) AS flow_tri FROM i0),
 i1 AS (SELECT *, greatest(high - low, abs(high - c1), abs(low - c1)) AS tr, close / c1 - 1 AS pct, macd - macd_1 AS macd_delta, {since('macd > 0 AND macd_1 <= 0')} AS macd_jx, {since('macd < 0 AND macd_1 >= 0')} AS macd_sx,
   {since('close > ma10 AND c1 <= ma10_1')} AS zen_jx, {since('ma10 > close AND ma10_1 <= c1')} AS zen_sx, {full(f'len(list_filter(list(close) {over(21)}, lambda v: v <= close)) / 21', 21)} AS z21, {full(f'regr_slope(dea, rn) {over(14)}', 14)} AS dea_slope,
   dea > 0 AND macd > dea AS higher_settle, {run('dual > 0')} AS dual_jx, boll + 2 * sd AS boll_ub, boll - 2 * sd AS boll_lb, {lag('line')} AS line_1, {lag('density')} AS density_1, avg(density) {over(21)} AS density_sma, CASE WHEN renko_s = renko_l THEN renko_s ELSE 0 END AS renko FROM ia),
 i2 AS (SELECT *, line - avg(tr) {over(14)} AS atr_lb, {lag('z21')} AS z21_1, sign(line - line_1) AS lr_dir, {run('density < density_1')} AS tide_sx, (boll_ub - boll_lb) / boll AS boll_channel, {lag('boll_ub')} AS boll_ub_1, {lag('boll_lb')} AS boll_lb_1,
   (boll_ub - ma90) / nullif(boll_ub - boll_lb, 0) AS clear90, sign(round(density - density_sma, 9)) AS combo FROM i1),
 ib AS (SELECT *, lr_dir - {lag('lr_dir')} AS turn FROM i2),
 i3 AS (SELECT *, {since('close > boll_lb AND c1 <= boll_lb_1')} AS boll_jx, {since('boll_ub > close AND boll_ub_1 <= c1')} AS boll_sx, {since('turn > 0')} AS lr_jx, {since('turn < 0')} AS lr_sx, sign(turn) AS lr_cross FROM ib),
 i4 AS (SELECT *, boll_channel - {lag('boll_channel')} AS boll_delta, sign(close - boll) AS atr_stop, sign(close - ma30) AS supertrend, sign(ma5 - ma10) AS vhma_dir, sign(close - boll) AS ml_trend, renko AS cluster, sign(close - open) AS patterns,
   macd_jx = 0 AS bootstrap_1, zen_jx = 0 AS bootstrap_2, macd_sx = 0 AS deadpool, {run('flow_tri > 0')} AS tri_jx, {run('flow_tri < 0')} AS tri_sx, flow_tri AS boost, volume > 60 AS bonus, (close > boll)::INT AS flu_up, (close < boll)::INT AS flu_down,
   (ma30 > ma90)::INT AS master_up, (NOT ma30 > ma90)::INT AS master_down, zen_jx AS boot_before FROM i3)"""
)


def _macd_trend_parts() -> str:
    parts, at = "", "i4"
    parts += f", t0 AS (SELECT *, CASE WHEN macd_sx = 0 THEN -1 WHEN macd_jx = 0 THEN 1 ELSE 0 END AS v FROM {at})"
    for k, r in enumerate(rules.MACD_TREND):
        zero = " AND v = 0" if r.open else ""
        parts += f", p{k} AS (SELECT *, coalesce(lag(v) {OW}, 0) AS prev FROM t{k}), t{k + 1} AS (SELECT * EXCLUDE (v, prev), CASE WHEN coalesce({r.predicate}, false){zero} THEN {r.value} ELSE v END AS v FROM p{k})"
    return parts


def _macd_trend_sql() -> str:
    return recursive(_INPUTS + _macd_trend_parts(), f"SELECT symbol, dt, (CASE WHEN coalesce({rules.MACD_SUPER}, false) THEN 1 ELSE v END)::BIGINT AS macd_trend FROM t{len(rules.MACD_TREND)}")


def macd_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.macd_trend(features(spark, sf_dir)).select("symbol", "dt", "macd_trend")


def _leverage_sql() -> str:
    u = f"{rules.UNIT}::DOUBLE"

    def vote(rise: str, fall: str) -> str:
        return f"(CASE WHEN up AND coalesce({rise}, false) THEN {u} WHEN down AND coalesce({fall}, false) THEN -{u} ELSE 0 END)"

    votes = [vote(f"{c} > 0", f"{c} < 0") for c in rules.LEVERAGE_SIGNALS]
    votes.append(f"(CASE WHEN up AND bootstrap_1 THEN 2 * {u} WHEN down AND bootstrap_2 THEN 1.236::DOUBLE * {u} WHEN down AND deadpool THEN -2 * {u} ELSE 0 END)")
    votes += [vote("tri_jx > 0", "tri_sx < 0"), f"(CASE WHEN up AND coalesce(boost > 0, false) THEN {u} WHEN down AND coalesce(boost < 0, false) THEN -{u} WHEN up AND bonus THEN {u} ELSE 0 END)"]
    votes += [vote("flu_up > 0", "flu_down > 0"), vote("master_up > 0", "master_down > 0")]
    parts = f""", l0 AS (SELECT *, coalesce(pct > 0 AND rsi_delta > 0, false) AS up, coalesce(pct < 0 AND rsi_delta < 0, false) AS down, {sma('dea_slope', 4)} AS s4, {sma('macd', 4)} AS m4 FROM i4),
 l1 AS (SELECT *, {' + '.join(votes)} AS x FROM l0), l2 AS (SELECT *, CASE WHEN coalesce(ma90 < ma120 AND ma30 < ma90 AND (dea < 0 OR density < 0.5), false) AND (coalesce(macd_delta < 0 AND boll_sx < boll_jx, false) OR down) THEN -abs(x) - {u} ELSE x END AS y FROM l1),
 l3 AS (SELECT symbol, dt, rn, CASE WHEN coalesce(s4 < 0 AND m4 < 0 AND density_sma < 0.512, false) AND NOT coalesce(boot_before > macd_sx, false) THEN y - 2 * {u} ELSE y END AS v FROM l2),
 lp AS (SELECT symbol, dt, rn, v, least(1, greatest(0, v)) AS p, 0::DOUBLE AS q FROM l3 WHERE rn = 1 UNION ALL SELECT d.symbol, d.dt, d.rn, d.v, least(1, greatest(0, p.p + d.v)), p.p FROM lp p JOIN l3 d ON d.symbol = p.symbol AND d.rn = p.rn + 1)"""
    return recursive(_INPUTS + parts, f"SELECT symbol, dt, {R('v')} AS delta, {R('p')} AS leverage, {R('q')} AS leverage_before FROM lp")


def smart_leverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rules.smart_leverage(features(spark, sf_dir)).withColumnRenamed("leverage_delta", "delta")
    return pick(df, {"delta": 4, "leverage": 4, "leverage_before": 4})


_MORE = f""", i5 AS (SELECT *, {_signed("CASE WHEN ma5 > ma30 AND ma30 > ma90 THEN 1 ELSE -1 END")} AS fullstack_lag, {_signed("sign(ma5 - ma30)")} AS halfstack_lag, {_signed("sign(ma10 - ma30)")} AS downrisk_lag, {_signed("sign(close - ma90)")} AS regtree_lag, ma10 / 100 AS hma10,
 {_signed("sign(dea)")} AS ground_zero_lag, dea > 0 AS ground_zero, pct AS dash_returns, {_signed("combo")} AS combo_lag, line - boll AS poly9_empirical, {_signed("renko_s")} AS dash_lag, {_signed("sign(macd)")} AS macd_zero_lag, density AS drawdown_ratio, density_sma AS drawdown_ratio_major,
 dual AS endpoints, boll_sx AS endpoints_before, {_signed("sign(ma30 - ma90)")} AS mapower30_lag_major, {_signed("sign(ma90 - ma120)")} AS hmapower120_lag_major, boll_lb AS poly9_checkout_atr_lb, ma120 AS mapower30_checkout_atr_lb, boll_jx AS peak_lag, zen_sx AS mapower30_low_before, boll_sx AS boll_lb_hma5_lag FROM i4),
 i6 AS (SELECT *, combo_lag AS poly9_checkout_lag, CASE WHEN quantile_cont(regtree_lag, 0.25) OVER () < -36 THEN quantile_cont(regtree_lag, 0.25) OVER () ELSE -72 END AS cut FROM i5)"""


def _screens_sql() -> str:
    labels = {"weakshort": rules.WEAKSHORT.format(cut="cut")} | rules.SCREENS
    tags = ", ".join(f"CASE WHEN {p} THEN '{k}' END" for k, p in labels.items())
    return recursive(_INPUTS + _MORE, f"SELECT symbol, dt, tags FROM (SELECT symbol, dt, concat_ws(',', {tags}) AS tags FROM i6) WHERE tags <> ''")


def feature_screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.screened(more_features(features(spark, sf_dir))).select("symbol", "dt", "tags")


def _strength_sql() -> str:
    trend = _macd_trend_parts()
    at = lambda k: f"CASE WHEN rn >= {k} + 13 THEN regr_slope(ma{k}, rn) {over(14)} END"
    rank = lambda c, n: full(f"len(list_filter(list({c}) {over(n)}, lambda v: v <= {c})) / {n}", n)
    every = [p for _, p in (*rules.STRENGTH_BUY, *rules.STRENGTH_SELL)] + [rules.STRENGTH_VETO, rules.SPIKE]
    lagged = ", ".join(f"lag({c}, {k}) {OW} AS {c}__{k}" for c, k in rules.lags_of(every) if c != "trigger")
    cut = next(i for i, (k, _) in enumerate(rules.STRENGTH_BUY) if k == 12)

    def last(found: tuple, default: str) -> str:
        return "CASE " + " ".join(f"WHEN coalesce({rules.plain(p)}, false) THEN {k}" for k, p in reversed(found)) + f" ELSE {default} END"

    parts = trend + f""", g0 AS (SELECT *, (CASE WHEN coalesce({rules.MACD_SUPER}, false) THEN 1 ELSE v END) AS macd_trend, 100 * (close - ma30) / ma30 AS bias3, {rank('close', 84)} AS z84, lag(dea) {OW} AS dea_1, max(high) {over(4)} AS renko_ub, min(close) {over(3)} AS low3,
   {full(f'regr_slope(close, rn) {over(14)}', 14)} AS slope, {at(30)} AS ma30_slope, {at(90)} AS ma90_slope, {at(120)} AS ma120_slope, avg(density) {over(8)} AS density_8, avg(z21) {over(8)} AS z21_8, avg(z21) {over(4)} AS z21_4, {since('renko_s > 0')} AS renko_before, {since('renko_s < 0')} AS renko_sx FROM t{len(rules.MACD_TREND)}),
 g1 AS (SELECT *, {since('dea > 0 AND dea_1 <= 0')} AS dea_jx, {rank('bias3', 21)} AS bias3_z, last_value(CASE WHEN boll_sx = 0 THEN dea END IGNORE NULLS) {UPTO} AS sx_dea, macd < 0 AND dea < 0 AND macd < dea AS neg_lower, dea < 0 AND macd_delta > 0 AS lower_settle,
   (boll_ub - ma120) / nullif(boll_ub - boll_lb, 0) AS clear120, {since('f_up')} AS factor_jx, {since('f_down')} AS factor_sx, macd_jx AS boot2_before, flow_tri AS rsrs, vhma_dir AS rsrs_held, lr_dir AS atr_cross, 0.001::DOUBLE AS baseline_slope FROM g0),
 g2 AS (SELECT *, {lagged} FROM g1), g3 AS (SELECT *, coalesce({rules.plain(rules.SPIKE)}, false) AS spike FROM g2), g4 AS (SELECT *, {last(rules.STRENGTH_BUY[:cut], '0')} AS trigger FROM g3),
 g5 AS (SELECT *, {", ".join(f"coalesce(lag(trigger, {k}) {OW}, 0) AS trigger__{k}" for k in (1, 2, 3, 4))} FROM g4), g6 AS (SELECT * EXCLUDE (trigger), {last(rules.STRENGTH_BUY[cut:], 'trigger')} AS trigger FROM g5),
 g7 AS (SELECT *, {last(rules.STRENGTH_SELL, '0')} AS s FROM g6), g8 AS (SELECT symbol, dt, rn, CASE WHEN trigger > 0 THEN trigger WHEN s < 0 AND coalesce({rules.plain(rules.STRENGTH_VETO)}, false) THEN -666 ELSE s END AS trig FROM g7),
 g9 AS (SELECT *, sign(({since('trig < 0')}) - ({since('trig > 0')})) AS side FROM g8)"""
    return recursive(_INPUTS + parts, f"SELECT symbol, dt, trig::BIGINT AS trigger_, {run('side > 0')} - ({run('side < 0')}) AS trigger_lag FROM g9")


def rps_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules of relative strength."""
    return rules.strength(strength_features(features(spark, sf_dir))).select("symbol", "dt", F.col("trigger").alias("trigger_"), "trigger_lag")


def band_features(df: DataFrame) -> DataFrame:
    """What the rules of the regression band read beside the strength rules' inputs; touches of the band are by the close."""
    df = strength_features(df)
    atr = F.col("line") - F.col("atr_lb")
    df = df.withColumns({"atr_ub": F.col("line") + atr, "atr_ratio": (2 * atr / F.col("line")) / F.nullif(F.col("boll_channel"), F.lit(0.0)), "drawdown": F.coalesce(F.ln(F.col("close") / W.lag("high")), F.lit(0.0)), "dual_sx": W.run_length(F.col("dual") < 0),
        "clear_sx": W.run_length(W.delta("clear90") < 0), "ma30_sx": W.bars_since(W.crossed("ma30", "ma5")), "under_6": F.sum((F.col("open") < F.col("ma30")).cast("int")).over(W.frame(6))})
    return df.withColumns({"drawdown_4": F.sum("drawdown").over(W.frame(4)), "atr_jx": W.bars_since(W.crossed("close", "atr_lb")), "atr_sx": W.bars_since(W.crossed("atr_ub", "close"))})


def _band_sql() -> str:
    before = _strength_sql().split("\n g2 AS (SELECT *,", 1)[0].rstrip(",")
    every = [*rules.BAND_SELL, *rules.BAND_BUY, rules.BAND_RISK, rules.BAND_EJECT]
    lagged = ", ".join(f"lag({c}, {k}) {OW} AS {c}__{k}" for c, k in rules.lags_of(every))
    quantiles = ", ".join(f"quantile_cont({c}, {p / 100}) {P} AS q_{c}_{round(10 * p):03d}" for c, ps in rules.BAND_QUANTILES.items() for p in ps)
    any_of = lambda ps: " OR ".join(f"coalesce({rules.plain(p)}, false)" for p in ps)
    return before + f""", h0 AS (SELECT *, 2 * line - atr_lb AS atr_ub, (2 * (line - atr_lb) / line) / nullif(boll_channel, 0) AS atr_ratio, coalesce(ln(close / lag(high) {OW}), 0) AS drawdown, {run('dual < 0')} AS dual_sx, clear90 - lag(clear90) {OW} AS clear_d,
   lag(ma5) {OW} AS ma5_1, sum((open < ma30)::INT) {over(6)} AS under_6, lag(atr_lb) {OW} AS atr_lb_1 FROM g1),
 h1 AS (SELECT *, {run('clear_d < 0')} AS clear_sx, {since('ma30 > ma5 AND ma30_1 <= ma5_1')} AS ma30_sx, sum(drawdown) {over(4)} AS drawdown_4, {since('close > atr_lb AND c1 <= atr_lb_1')} AS atr_jx, lag(atr_ub) {OW} AS atr_ub_1 FROM h0),
 h2 AS (SELECT *, {since('atr_ub > close AND atr_ub_1 <= c1')} AS atr_sx, {full(f'avg(lr_dir) {over(4)}', 4)} * 4 AS dir_4, {lagged} FROM h1),
 h3 AS (SELECT *, coalesce({rules.plain(rules.BAND_EJECT)}, false) AS eject FROM h2), h4 AS (SELECT *, CASE WHEN lr_dir > 0 AND NOT eject THEN 1 WHEN lr_dir < 0 THEN -1 ELSE 0 END AS trend2 FROM h3),
 h5 AS (SELECT *, trend2 - lag(trend2) {OW} AS turn2 FROM h4), h6 AS (SELECT *, coalesce(sign(turn2), 0) AS lr2_cross, {since('turn2 > 0')} AS lr2_jx, {since('turn2 < 0')} AS lr2_sx, CASE WHEN {rules.BAND_TOUCHED} THEN drawdown END AS touched FROM h5),
 h7 AS (SELECT *, sum(lr2_cross) {over(4)} AS cross_4, {quantiles} FROM h6),
 h8 AS (SELECT symbol, dt, rn, CASE WHEN ({any_of(rules.BAND_BUY)}) AND coalesce({rules.plain(rules.BAND_RISK)}, false) THEN 1 WHEN {any_of(rules.BAND_SELL)} THEN -1 ELSE 0 END AS band FROM h7)
 SELECT symbol, dt, band::BIGINT AS band, {since('band = 1')} AS band_jx, {since('band = -1')} AS band_sx FROM h8"""


def regression_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.regression_band(band_features(features(spark, sf_dir))).select("symbol", "dt", "band", "band_jx", "band_sx")


_CHOOSE = f""", k0 AS (SELECT *, {_signed("sign(dea)")} AS ground_zero_lag, dea > 0 AS ground_zero, {_signed("combo")} AS combo_lag, {_signed("renko_s")} AS ground_zero_minor_lag, {_signed("renko")} AS boll_renko_lag, factor AS trigger_r5, dual AS position_r5, flow_tri AS trigger_rps, pct AS combo_returns,
 lag(pct) {OW} AS combo_minor_returns, renko_l AS cluster_minor, {_signed("sign(ma5 - ma30)")} AS rail_lag, factor AS onhold, density AS leverage, macd < 0 AND dea < 0 AND macd < dea AS neg_lower, 100 * (close - ma30) / ma30 AS bias3, {full(f"len(list_filter(list(close) {over(84)}, lambda v: v <= close)) / 84", 84)} AS z84,
 {full(f"(avg(pct) {over(60)} - 0.02::DOUBLE / 252) / nullif(stddev_samp(pct) {over(60)}, 0) * sqrt(252)", 60)} AS sharpe, {full(f"avg(pct) {over(60)} / nullif(sqrt(avg(CASE WHEN pct < 0 THEN pct * pct ELSE 0 END) {over(60)}), 0) * sqrt(252)", 60)} AS sortino FROM i4)"""


def choice_features(df: DataFrame) -> DataFrame:
    """What the store's predicates and the selector read beside the other inputs: Sharpe and Sortino ratios of 60 bars, BIAS of
    30; triggers, rails and groups are given by plain expressions."""
    ret = F.col("pct")
    sharpe = (F.avg(ret).over(W.frame(60)) - 0.02 / 252) / F.nullif(F.stddev_samp(ret).over(W.frame(60)), F.lit(0.0)) * (252**0.5)
    sortino = F.avg(ret).over(W.frame(60)) / F.nullif(F.sqrt(F.avg(F.when(ret < 0, ret * ret).otherwise(0.0)).over(W.frame(60))), F.lit(0.0)) * (252**0.5)
    return df.withColumns({
        "ground_zero_minor_lag": W.signed_run(F.col("renko_s")), "boll_renko_lag": W.signed_run(F.col("renko")), "trigger_r5": F.col("factor"), "position_r5": F.col("dual"), "trigger_rps": F.col("flow_tri"), "combo_returns": ret, "combo_minor_returns": W.lag("pct"),
        "cluster_minor": F.col("renko_l"), "rail_lag": F.col("halfstack_lag"), "onhold": F.col("factor"), "leverage": F.col("density"), "neg_lower": (F.col("macd") < 0) & (F.col("dea") < 0) & (F.col("macd") < F.col("dea")),
        "bias3": 100 * (F.col("close") - F.col("ma30")) / F.col("ma30"), "z84": W.pct_rank("close", 84), "sharpe": W.full(sharpe, 60), "sortino": W.full(sortino, 60),
    })


def store_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.stored(choice_features(features(spark, sf_dir))).select("symbol", "dt", *[F.col(f"is_{k}") for k in rules.STORE])


def _store_sql() -> str:
    flags = ", ".join(f"coalesce({p}, false) AS is_{k}" for k, p in rules.STORE.items())
    return recursive(_INPUTS + _CHOOSE, f"SELECT * FROM (SELECT symbol, dt, {flags} FROM k0) WHERE {' OR '.join(f'is_{k}' for k in rules.STORE)}")


def selector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = choice_features(features(spark, sf_dir))
    market = df.groupBy("dt").agg(F.sum(F.signum(F.coalesce("pct", F.lit(0.0)))).alias("flow"))
    return rules.selected(df, market).select("symbol", "dt", "grade", "retreat")


def _selector_sql() -> str:
    lagged = ", ".join(f"lag({c}, {k}) {OW} AS {c}__{k}" for c, k in rules.lags_of(rules.GROUPS))
    group = " ".join(f"WHEN coalesce({rules.plain(p)}, false) THEN {i}" for i, p in enumerate(rules.GROUPS))
    parts = f", k1 AS (SELECT *, {lagged} FROM k0), km AS (SELECT dt, sum(sign(coalesce(pct, 0))) AS flow FROM k0 GROUP BY dt)"
    return recursive(_INPUTS + _CHOOSE + parts, f"SELECT symbol, dt, (CASE {group} ELSE {len(rules.GROUPS)} END)::BIGINT AS grade, coalesce(flow < 0, false) AS retreat FROM k1 JOIN km USING (dt) WHERE NOT coalesce({rules.FADE}, false) AND coalesce({rules.BEST}, false)")


def order_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = strength_features(features(spark, sf_dir))
    df = rules.smart_leverage(df.select("symbol", "dt", "rn", "close", *_VOTED))
    df = df.withColumn("__c", F.coalesce(F.col("clear90") + F.col("clear120"), F.lit(0.0))).withColumn("__s", F.col("factor").cast("double"))
    done = I.with_kernel(df, ["leverage_delta", "leverage", "leverage_before", "__s", "__c"], "order double, missed bigint, held double", backtest.order_positions, [])
    return done.select("symbol", "dt", *[r(F.col(c)).alias(f"{c}_") for c in ("order", "held")], "missed")


_VOTED = (
    *rules.LEVERAGE_SIGNALS, "pct", "rsi_delta", "bootstrap_1", "bootstrap_2", "deadpool", "tri_jx", "tri_sx", "boost", "bonus", "flu_up", "flu_down", "master_up", "master_down", "ma90", "ma120", "ma30", "dea", "density",
    "macd_delta", "boll_sx", "boll_jx", "dea_slope", "macd", "density_sma", "boot_before", "macd_sx", "clear90", "clear120",
)


def _orders_sql() -> str:
    head = _leverage_sql().rsplit("SELECT symbol, dt, (round(v", 1)[0].rstrip()
    move = "(p.q - p.p)"
    at_once = f"CASE WHEN p.s < 0 THEN p.c > {backtest.HIGH}::DOUBLE OR {move} < {backtest.GIVE_UP}::DOUBLE ELSE NOT coalesce(o.held + {move} > 0, false) END"
    return head + f""", os AS (SELECT lp.symbol, lp.dt, lp.rn, lp.v, lp.p, lp.q, i4.factor AS s, coalesce(clear90 + (boll_ub - ma120) / nullif(boll_ub - boll_lb, 0), 0) AS c FROM lp JOIN i4 ON i4.symbol = lp.symbol AND i4.rn = lp.rn),
 oo AS (SELECT symbol, NULL::TIMESTAMP AS dt, 0::BIGINT AS rn, 0::DOUBLE AS ord, 0 AS missed, 0::DOUBLE AS held FROM os WHERE rn = 1 UNION ALL
 SELECT p.symbol, p.dt, p.rn, CASE WHEN {move} > 0 THEN CASE WHEN p.s > 0 THEN CASE WHEN p.c > {backtest.HIGH}::DOUBLE THEN abs(greatest({move}, p.v)) ELSE abs(p.p) END WHEN o.held > 0 THEN {move} ELSE 0 END
   WHEN {move} < 0 THEN CASE WHEN {at_once} THEN -CASE WHEN o.held > p.q THEN o.held ELSE p.q END ELSE {move} END ELSE 0 END,
   CASE WHEN {move} > 0 AND coalesce(p.s, 0) <= 0 AND NOT coalesce(o.held > 0, false) THEN 1 ELSE o.missed END,
   CASE WHEN {move} > 0 THEN CASE WHEN p.s > 0 THEN CASE WHEN p.c > {backtest.HIGH}::DOUBLE THEN abs(greatest({move}, p.v)) ELSE abs(p.p) END WHEN o.held > 0 THEN o.held + {move} ELSE o.held END
   WHEN {move} < 0 THEN CASE WHEN {at_once} THEN 0 ELSE o.held + {move} END ELSE o.held END FROM oo o JOIN os p ON p.symbol = o.symbol AND p.rn = o.rn + 1)
 SELECT symbol, dt, {R('ord')} AS order_, {R('held')} AS held_, missed::BIGINT AS missed FROM oo WHERE rn > 0"""


QUERIES |= {"store_predicates": store_predicates, "selector_groups": selector_groups, "order_positions": order_positions, "regression_band": regression_band, "rps_rules": rps_rules, "macd_trend": macd_trend, "smart_leverage": smart_leverage, "feature_screens": feature_screens}
ORACLES |= {"store_predicates": _store_sql(), "selector_groups": _selector_sql(), "order_positions": _orders_sql(), "regression_band": _band_sql(), "rps_rules": _strength_sql(), "macd_trend": _macd_trend_sql(), "smart_leverage": _leverage_sql(), "feature_screens": _screens_sql()}
