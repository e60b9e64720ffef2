"""Technical indicators of a bar table: fused kernels for recurrences, windows for the rest.

Functions that end in a kernel call share one exchange on symbol; what follows in windows needs no other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import window as W
from . import kernels as K


def _joined(bars: DataFrame, found: DataFrame) -> DataFrame:
    return bars.join(found, ["symbol", "dt"])


def with_kernel(bars: DataFrame, columns: list[str], schema: str, kernel, keep: list[str] | None = None) -> DataFrame:
    """Kernel columns next to the columns of keep (all, if it isn't given). The columns of keep cross with those that the
    kernel reads, in the same exchange, and come back as they are, whatever their type."""
    keep = keep if keep is not None else [c for c in bars.columns if c not in ("symbol", "dt")]
    return K.by_symbol(bars, columns, schema, kernel, keep=keep)


def macd_frame(bars: DataFrame) -> DataFrame:
    """dif, dea, macd."""
    def kernel(c: np.ndarray) -> dict:
        dif, dea, bar = K.macd(c)
        return {"dif": dif, "dea": dea, "macd": bar}

    return with_kernel(bars, ["close"], "dif double, dea double, macd double", kernel)


def macd_cross(bars: DataFrame) -> DataFrame:
    """Cross and state of MACD, bars since zero crossings, DEA slope, price-state flags, z-scores, signed runs, turnover."""
    df = W.numbered(macd_frame(bars))
    dif0, dea0, bar0 = (F.when(F.col("rn") > n, F.col(c)).otherwise(0.0) for c, n in (("dif", 24), ("dea", 31), ("macd", 31)))
    df = df.withColumns({"dif": dif0, "dea": dea0, "macd": bar0})
    prev = {c: F.coalesce(W.lag(c), F.lit(0.0)) for c in ("dif", "dea", "macd")}
    df = df.withColumns({f"__{c}": x for c, x in prev.items()})
    cross = F.when((F.col("macd") > 0) & (F.col("__macd") < 0), 1).when((F.col("macd") < 0) & (F.col("__macd") > 0), -1).otherwise(0)
    state = F.when((F.col("macd") > 0) & (F.col("macd") > F.col("__macd")), 1).when((F.col("macd") < 0) & (F.col("macd") < F.col("__macd")), -1).otherwise(0)
    df = df.withColumns({"cross": cross.cast("bigint"), "state": state.cast("bigint")})
    for c in ("macd", "dea", "dif"):
        up, down = (F.col(c) > 0) & (F.col(f"__{c}") <= 0), (F.col(c) < 0) & (F.col(f"__{c}") >= 0)
        df = df.withColumns({f"{c}_up_before": W.bars_since(up), f"{c}_down_before": W.bars_since(down)})
    bar, dea, dif = F.col("macd"), F.col("dea"), F.col("dif")
    deep = ((dea < 0) & ((F.col("dea_down_before") > 6) | (F.col("macd_down_before") > 12))) | ((dif < 0) & (F.col("macd_down_before") > 12))
    lower = ((bar < 0) & (dea < 0) & (bar < dea)) | ((bar < 0) & deep & (bar < dea) & (F.abs(bar) > F.abs(dea)))
    df = df.withColumns({
        "negative_lower": lower.cast("bigint"),
        "lower_settle": (~lower & (dea < 0) & (bar > F.col("__macd"))).cast("bigint"),
        "higher_settle": ((dea > 0) & (bar > dea)).cast("bigint"),
        "dea_slope": W.ols_slope("dea", 14),
        "run": W.signed_run(F.col("state")),
        "turn": (F.signum("dea") != F.signum("__dea")).cast("int"),
    })
    norms = {f"{c}_norm": (F.col(c) - F.avg(c).over(W.whole())) / F.nullif(F.stddev_pop(c).over(W.whole()), F.lit(0.0)) for c in ("macd", "dea")}
    df = df.withColumns(norms | {"turnover": W.rolling(F.sum, "turn", 252) / 2.0})
    return df.drop("__dif", "__dea", "__macd", "turn")


def kdj_frame(bars: DataFrame, n: int = 9) -> DataFrame:
    def kernel(h: np.ndarray, low: np.ndarray, c: np.ndarray) -> dict:
        k, d, j = K.kdj(h, low, c, n)
        return {"k": k, "d": d, "j": j}

    return with_kernel(bars, ["high", "low", "close"], "k double, d double, j double", kernel)


def kdj_cross(bars: DataFrame) -> DataFrame:
    """State of J against D, just formed golden cross below 30 and dead cross above 70, signed run."""
    df = W.numbered(kdj_frame(bars))
    golden, dead = W.crossed("k", "d") & (F.col("d") <= 30), W.crossed("d", "k") & (F.col("d") >= 70)
    state = F.when(F.col("j") > F.col("d"), 1).when(F.col("j") < F.col("d"), -1).otherwise(0)
    df = df.withColumns({"golden": golden.cast("bigint"), "dead": dead.cast("bigint"), "state": state.cast("bigint")})
    return df.withColumn("run", W.signed_run(F.col("state")))


def rsi_frame(bars: DataFrame, lengths: tuple[int, ...] = (6, 12, 24)) -> DataFrame:
    def kernel(c: np.ndarray) -> dict:
        return {f"rsi_{n}": K.rsi(c, n) for n in lengths}

    return with_kernel(bars, ["close"], ", ".join(f"rsi_{n} double" for n in lengths), kernel)


def rsi_cross(bars: DataFrame) -> DataFrame:
    """1 while rsi 6 > 12 > 24, -1 while 6 < 12 < 24, and the signed run."""
    df = W.numbered(rsi_frame(bars))
    a, b, c = F.col("rsi_6"), F.col("rsi_12"), F.col("rsi_24")
    df = df.withColumn("state", F.when((a > b) & (b > c), 1).when((a < b) & (b < c), -1).otherwise(0).cast("bigint"))
    return df.withColumn("run", W.signed_run(F.col("state")))


def atr_frame(bars: DataFrame, n: int = 14) -> DataFrame:
    def kernel(h: np.ndarray, low: np.ndarray, c: np.ndarray) -> dict:
        return {"atr": K.atr(h, low, c, n)}

    return with_kernel(bars, ["high", "low", "close"], "atr double", kernel)


def trend_frame(bars: DataFrame) -> DataFrame:
    """Stop line, super trend, volume-weighted Hull mean and regression band in one pass, with signed runs and held returns."""

    def kernel(o, h, low, c, v) -> dict:
        line, trend = K.supertrend(h, low, c)
        ub, lb, stop = K.stop_line(o, h, low, c)
        vline, vdir = K.volume_hma(c, v)
        mid, up, down, band = K.linreg_band(h, low, c)
        names = "st_line st_trend atr_ub atr_lb atr_trend vhma vhma_dir lr_line lr_ub lr_lb lr_dir"
        return dict(zip(names.split(), (line, trend, ub, lb, stop, vline, vdir, mid, up, down, band)))

    schema = "st_line double, st_trend bigint, atr_ub double, atr_lb double, atr_trend bigint, vhma double, vhma_dir bigint, lr_line double, lr_ub double, lr_lb double, lr_dir bigint"
    df = W.numbered(with_kernel(bars, ["open", "high", "low", "close", "volume"], schema, kernel))
    return df.withColumns({f"{c}_run": W.signed_run(F.col(c)) for c in ("st_trend", "atr_trend", "vhma_dir", "lr_dir")})


def adxm(bars: DataFrame, n: int = 14) -> DataFrame:
    """Hull-mean ADX: directional moves from relative changes of high and low over the Hull mean of the true range."""
    df = W.numbered(bars)
    up, down = F.coalesce(W.pct_change("high"), F.lit(0.0)), F.coalesce(-W.pct_change("low"), F.lit(0.0))
    df = df.withColumns({"__up": up, "__dn": down, "__pc": W.lag("close")})
    df = df.withColumns({
        "__p": F.when((F.col("__up") > F.col("__dn")) & (F.col("__up") > 0), F.col("__up")).otherwise(0.0),
        "__m": F.when((F.col("__dn") > F.col("__up")) & (F.col("__dn") > 0), F.col("__dn")).otherwise(0.0),
        "__tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("__pc")), F.abs(F.col("low") - F.col("__pc"))),
    })
    for c in ("p", "m", "tr"):
        df = W.hma(df, f"__{c}", n, f"__h{c}")
    plus, minus = (100 * F.col(f"__h{c}") / F.nullif(F.col("__htr"), F.lit(0.0)) for c in "pm")
    df = df.withColumns({"plus": plus, "minus": minus})
    total = F.col("plus") + F.col("minus")
    df = df.withColumn("__dx", F.abs(F.col("plus") - F.col("minus")) / F.nullif(total, F.lit(0.0)))
    df = W.hma(df, "__dx", n, "__adx")
    df = df.withColumn("adx", 100 * F.col("__adx"))
    way = F.when(F.col("adx") > 18, F.when(F.col("plus") > F.col("minus"), 1).otherwise(-1)).otherwise(0)
    return df.withColumn("direction", way.cast("bigint")).drop(*[c for c in df.columns if c.startswith("__")])


def maxfactor_cross(bars: DataFrame) -> DataFrame:
    """MAXFACTOR = CCI + 4(RSI - 50) + 4(J - 50) against its EMA of 5: state, bars since the cross, signed run; and the
    dual cross: CCI beyond 4(RSI - 50) and J, or J moved on by its last change, beyond RSI on the same side; 0 between and
    in the first 13 rows."""

    def kernel(h, low, c) -> dict:
        cci, rsi, (_, _, j) = np.nan_to_num(K.cci(h, low, c)), np.nan_to_num(K.rsi(c, 12)), K.kdj(h, low, c)
        factor = cci + 4 * (rsi - 50) + 4 * (j - 50)
        return {"cci": cci, "rsi": rsi, "j": j, "maxfactor": factor, "maxfactor_ma": K.ema_first(factor, 5)}

    df = W.numbered(with_kernel(bars, ["high", "low", "close"], "cci double, rsi double, j double, maxfactor double, maxfactor_ma double", kernel))
    line, rsi, j = 4 * (F.col("rsi") - 50), F.col("rsi"), F.col("j")
    on = j + W.delta("j")
    up, down = (F.col("cci") > line) & ((j > rsi) | (on > rsi)), (F.col("cci") < line) & ((j < rsi) | (on < rsi))
    df = df.withColumns({
        "state": F.signum(F.col("maxfactor") - F.col("maxfactor_ma")).cast("bigint"),
        "dual": F.when(F.col("rn") <= 13, 0).when(up, 1).when(down, -1).otherwise(0).cast("bigint"),
    })
    df = df.withColumns({"up_before": W.bars_since(W.crossed("maxfactor", "maxfactor_ma")), "down_before": W.bars_since(W.crossed("maxfactor_ma", "maxfactor"))})
    return df.withColumns({"run": W.signed_run(F.col("state")), "dual_run": W.signed_run(F.col("dual"))})


MA_LENGTHS = (5, 10, 20, 30, 60, 90, 120)


def ma_system(bars: DataFrame) -> DataFrame:
    """Moving averages, their crosses and ages, the slope of MA30, and the run of the bull alignment. Needs no kernel."""
    df = W.numbered(bars) if "rn" not in bars.columns else bars
    df = df.withColumns({f"ma{n}": W.sma("close", n) for n in MA_LENGTHS})
    crosses = {}
    for a, b in ((5, 10), (5, 30), (90, 120)):
        up, down = W.crossed(f"ma{a}", f"ma{b}"), W.crossed(f"ma{b}", f"ma{a}")
        crosses |= {f"cross_{a}_{b}": F.when(up, 1).when(down, -1).otherwise(0).cast("bigint"), f"jx_{a}_{b}": W.bars_since(up), f"sx_{a}_{b}": W.bars_since(down)}
    aligned = (F.col("ma5") > F.col("ma10")) & (F.col("ma10") > F.col("ma20")) & (F.col("ma20") > F.col("ma30"))
    df = df.withColumns(crosses | {"aligned_run": W.run_length(aligned), "ma30_slope": F.when(F.col("rn") >= 43, F.regr_slope("ma30", "rn").over(W.frame(14)))})
    return df.withColumn("ma30_slope_change", W.delta("ma30_slope"))


def clearances(bars: DataFrame) -> DataFrame:
    """Distance of the price and the averages to the upper band in band widths; dispersion and channel of the averages."""
    df = ma_system(bars)
    mid, sd = W.sma("close", 20), W.rolling(F.stddev_pop, "close", 20)
    df = df.withColumns({"ub": mid + 2 * sd, "lb": mid - 2 * sd})
    width = F.nullif(F.col("ub") - F.col("lb"), F.lit(0.0))
    cols = {f"clear_{c}": (F.col("ub") - F.col(c)) / width for c in ("close", "ma5", "ma10", "ma20", "ma30", "ma60", "ma90")}
    averages = [F.col(f"ma{n}") for n in MA_LENGTHS]
    top, bottom = F.greatest(*averages), F.least(*averages)
    every = F.when(F.col("ma120").isNotNull(), (top - bottom) / F.col("ma20"))
    df = df.withColumns(cols | {"ma_channel": every})
    return df.withColumn("channel_run", W.signed_run(F.signum(W.delta("ma_channel"))))


def boll_cross(bars: DataFrame) -> DataFrame:
    """Rise of the smoothed low through the lower band, fall of the smoothed high through the upper band, ages and trend."""
    df = W.numbered(bars)
    mid, sd = W.sma("close", 20), W.rolling(F.stddev_pop, "close", 20)
    df = df.withColumns({"ub": mid + 2 * sd, "lb": mid - 2 * sd, "__lo": W.sma("low", 3), "__hi": W.sma("high", 3)})
    df = df.withColumns({"jx": W.crossed("__lo", "lb"), "sx": W.crossed("ub", "__hi")})
    df = df.withColumns({"jx_before": W.bars_since(F.col("jx")), "sx_before": W.bars_since(F.col("sx"))})
    return df.withColumns({"trend": F.col("sx_before") - F.col("jx_before"), "jx": F.col("jx").cast("bigint"), "sx": F.col("sx").cast("bigint")}).drop("__lo", "__hi")


def ma_power(bars: DataFrame, lengths: range = range(5, 30)) -> DataFrame:
    """Share of pairs of averages in which the shorter stands above the longer; 0 before the longest is full."""
    df = W.numbered(bars)
    df = df.withColumn("__v", F.array(*[W.sma("close", n, partial=True) for n in lengths]))
    k = len(lengths)
    above = F.aggregate(
        F.transform("__v", lambda x, i: F.size(F.filter(F.slice("__v", i + 2, F.lit(k)), lambda y: x > y))), F.lit(0), lambda a, x: a + x
    )
    return df.withColumn("power", F.when(F.col("rn") < max(lengths), 0.0).otherwise(above * 2.0 / (k * (k - 1)))).drop("__v")


def volume_flow(bars: DataFrame) -> DataFrame:
    """Signed flow, accumulation line and its oscillator, MA5 against MA10 of volume, percentile ranks and runs."""

    def kernel(h, low, c, v) -> dict:
        ad = K.accumulation(h, low, c, v)
        return {"ad": ad, "adosc": K.adosc(ad)}

    df = W.numbered(with_kernel(bars, ["high", "low", "close", "volume"], "ad double, adosc double", kernel))
    df = df.withColumn("__ret", F.coalesce(W.log_return("close"), F.lit(0.0)))
    df = df.withColumns({
        "flow": F.signum(F.sum("__ret").over(W.frame(4))) * F.avg("volume").over(W.frame(4)),
        "vol5": W.sma("volume", 5), "vol10": W.sma("volume", 10),
    })
    tri = (F.signum("flow") + F.signum("adosc") + F.signum(F.col("vol5") - F.col("vol10"))).cast("bigint")
    df = df.withColumns({"tri": F.coalesce(tri, F.lit(0).cast("bigint")), "rank21": W.pct_rank("flow", 21), "rank84": W.pct_rank("flow", 84)})
    return df.withColumns({"flow_run": W.signed_run(F.col("flow")), "tri_run": W.signed_run(F.col("tri"))}).drop("__ret")


def bollinger_box(bars: DataFrame) -> DataFrame:
    """Band values held from the last touch of either band, drawdown inside the box, and the run of a raised box."""
    df = W.numbered(bars)
    mid, sd = W.sma("close", 20), W.rolling(F.stddev_pop, "close", 20)
    df = df.withColumns({"mid": mid, "ub": mid + 2 * sd, "lb": mid - 2 * sd})
    df = df.withColumns({"high_at": W.last_at(F.col("close") > F.col("ub"), "close"), "low_at": W.last_at(F.col("close") < F.col("lb"), "close"), "mid_at": W.last_at(W.crossed("close", "mid"), "close")})
    df = df.withColumns({"drawdown": (F.col("close") - F.col("high_at")) / F.col("high_at"), "rise": (F.col("close") - F.col("low_at")) / F.col("low_at")})
    return df.withColumn("raised_run", W.run_length(F.col("mid_at") > W.last_at(F.col("close") < F.col("lb"), "close")))


def bias_cross(bars: DataFrame) -> DataFrame:
    """Percentile rank of BIAS10, its zero crossings, and the run in which the three biases agree."""
    df = W.numbered(bars)
    df = df.withColumns({f"bias_{n}": 100 * (F.col("close") - W.sma("close", n)) / W.sma("close", n) for n in (10, 20, 30)})
    agree = F.when((F.col("bias_10") > 0) & (F.col("bias_20") > 0) & (F.col("bias_30") > 0), 1).when((F.col("bias_10") < 0) & (F.col("bias_20") < 0) & (F.col("bias_30") < 0), -1).otherwise(0)
    df = df.withColumns({"rank": W.pct_rank("bias_10", 21), "agree": agree.cast("bigint"), "__zero": F.lit(0.0)})
    cross = F.when(W.crossed("bias_10", "__zero"), 1).when(W.crossed("__zero", "bias_10"), -1).otherwise(0)
    return df.withColumns({"cross": cross.cast("bigint"), "run": W.signed_run(F.col("agree"))}).drop("__zero")


def combo_flow(df: DataFrame, densities: list[str]) -> DataFrame:
    """Mean of densities, its mean of 21 bars and slope, the cross of both and the tide's signed run. Needs rn."""
    combo = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in densities), F.lit(0.0)) / len(densities)
    df = df.withColumn("combo", combo)
    df = df.withColumns({"combo_ma": W.sma("combo", 21), "combo_slope": W.ols_slope("combo", 14)})
    df = df.withColumns({"__over": F.round(F.col("combo") - F.col("combo_ma"), 12), "__level": F.lit(0.0)})  # a constant equals its mean
    return df.withColumns({"combo_cross": W.crossed("__over", "__level").cast("bigint"), "combo_run": W.signed_run(F.signum("combo_slope"))}).drop("__over", "__level")


def cross_density(bars: DataFrame, up: str, down: str) -> DataFrame:
    """Density of two cross flags over a window that comes from their ages."""

    def kernel(a, b) -> dict:
        n, share = K.density(a > 0, b > 0)
        return {"window": np.full(len(a), n, np.int64), "density": share}

    return with_kernel(bars, [up, down], "window bigint, density double", kernel)


def wave_corr(df: DataFrame, run: str, a: str, b: str, out: str) -> DataFrame:
    """Correlation of two columns over the current run (its length is in run), null where one doesn't vary. A run's rows
    share rn - run."""
    from pyspark.sql import Window

    phase = Window.partitionBy("symbol", F.col("rn") - F.abs(run)).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    spread = F.stddev_pop(a).over(phase) * F.stddev_pop(b).over(phase)
    return df.withColumn(out, F.covar_pop(a, b).over(phase) / F.nullif(spread, F.lit(0.0)))


def smart_leverage(df: DataFrame, delta: str) -> DataFrame:
    """Position held in [0, 1] from votes, and the position of the bar before."""

    def kernel(d) -> dict:
        p, q = K.clamped_sum(np.nan_to_num(d))
        return {"leverage": p, "leverage_before": q}

    return with_kernel(df, [delta], "leverage double, leverage_before double", kernel)


def peaks(bars: DataFrame) -> DataFrame:
    """Robust z-score peaks, the weighted pair of detectors and eager extrema of the Hull mean."""

    def kernel(c) -> dict:
        return {"peak": K.zscore_peaks(c, 10, 3.0, 0.5), "points": K.peak_points(c), "eager": K.eager_extrema(c)}

    return with_kernel(bars, ["close"], "peak bigint, points bigint, eager bigint", kernel)


def poly9(bars: DataFrame) -> DataFrame:
    return with_kernel(bars, ["close"], "poly9 double", lambda c: {"poly9": K.poly_end(c)})
