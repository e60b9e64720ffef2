"""Feature registry and compound features that are plain expressions over named input columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import window as W
from . import indicators as I

#: Sums of two model families.
SUMS = {
    "ftr_01": ("drawdown_ratio_major", "drawdown_ratio", "mapower30_major"),
    "ftr_02": ("mapower30_major", "hmapower120_major", "mapower30"),
}


def rising(c: str, k: int = 1) -> Column:
    return F.col(c) > W.lag(c, k)


def conditions(df: DataFrame, uprising: bool = False) -> DataFrame:
    """Adds ftr_01, ftr_02 and cond_01 to cond_12, with uprising up to cond_19. Null inputs give false."""
    c = F.col
    pad = c("atr_lb") - c("boll_lb")
    df = df.withColumns({"__pad": pad} | {k: sum((c(x) for x in xs[1:]), c(xs[0])) for k, xs in SUMS.items()})
    found = {
        1: c("negative_lower_before") > c("mapower30_low_before"),
        2: rising("mapower_baseline", 8),
        3: c("atr_lb") > c("boll_lb"),
        4: rising("__pad"),
        5: c("ma120") > c("ma90"),
        6: (c("mapower30_low_before") < c("mapower30_high_before"))
        & (F.greatest(c("mapower30_low_before"), c("mapower_hmapower120_lag")) + c("deadpool_lag") < 0),
        7: c("dea") < c("macd_peak_low"),
        8: rising("atr_lb") & rising("boll_lb"),
        9: c("poly9") < c("atr_lb"),
        10: c("boll_lb_hma5_lag") + c("deadpool_lag") > 0,
        11: c("hmapower120_major") > c("mapower30_major"),
        12: rising("atr_lb") & (rising("boll_lb") | (c("boll_delta") > 0)),
    }
    if uprising:
        low = F.least(c("mapower30_low_before"), c("mapower30_low_before_major"))
        wide = (c("ma90_clearance") > -0.618) & (c("ma_channel") < 0.0382)
        found |= {
            13: (c("macd_zero_lag") > 0) & (c("hmapower120_lag") < 0),
            14: (c("uprising") > 0) & (c("uprising") > c("dea_zero_lag")),
            15: (c("mapower30_lag_major") > 0) & (c("mapower30_lag_major") > c("dea_zero_lag")),
            16: (c("hmapower120_lag_major") > 0) & (c("hmapower120_lag_major") < low),
            17: (c("ma90") > c("ma120"))
            & ((c("ma90_clearance_lag") + c("uprising_lag") > 0) | ((c("ma90_trend_lag") + c("uprising_lag") > 0) & wide)),
            18: c("mapower30_low_before") + c("deadpool_lag") < 0,
            19: c("hmapower120_low_before") + c("deadpool_lag") < 0,
        }
    return df.withColumns({f"cond_{k:02d}": F.coalesce(x, F.lit(False)) for k, x in found.items()}).drop("__pad")


def regression_cross(bars: DataFrame) -> DataFrame:
    """Regression line +- ATR against the price: channel, turns of the line's direction and their ages, touches of the bands by
    spike-smoothed extremes, and two percentile-rank scores of price and distance to the lower band."""
    df = I.trend_frame(bars).drop("st_line", "st_trend", "atr_ub", "atr_lb", "atr_trend", "vhma", "vhma_dir", "st_trend_run", "atr_trend_run", "vhma_dir_run")
    turn = F.coalesce(F.col("lr_dir") - W.lag("lr_dir"), F.lit(0))
    df = df.withColumns({
        "channel": (F.col("lr_ub") - F.col("lr_lb")) / F.col("lr_line"),
        "cross": F.signum(turn).cast("bigint"), "jx_before": W.bars_since(turn > 0), "sx_before": W.bars_since(turn < 0),
        "__lo2": W.sma("low", 2), "__hi2": W.sma("high", 2), "slope": W.ols_slope("close", 14), "padding": F.col("close") - F.col("lr_lb"),
        "drawdown": F.coalesce(F.ln(F.col("close") / W.lag("high")), F.lit(0.0)),
    })
    under, over = F.col("open") < F.col("lr_line"), F.col("open") > F.col("lr_line")
    df = df.withColumns({
        "min_peak": F.least("close", "open", F.when(under, F.col("low")).otherwise(F.col("__lo2"))),
        "max_peak": F.greatest("close", "open", F.when(over, F.col("high")).otherwise(F.col("__hi2"))),
        "slope_ub": W.full(F.percentile(F.abs("slope"), F.lit(0.5)).over(W.frame(20)), 33), "drawdown_3": F.sum("drawdown").over(W.frame(3)), "drawdown_4": F.sum("drawdown").over(W.frame(4)),
    })
    df = df.withColumns({"band_jx_before": W.bars_since(W.crossed("min_peak", "lr_lb")), "band_sx_before": W.bars_since(W.crossed("lr_ub", "max_peak"))})
    for n in (21, 84):
        price, pad = W.pct_rank("close", n), W.full(W.pct_rank("padding", n), n + 19)
        df = df.withColumn(f"score_{n}", F.when(price < 0.618, (pad + price) / 2).otherwise(price))
    boost = F.signum(F.col("score_21") - F.col("score_84"))
    return df.withColumn("boost_run", W.signed_run(boost)).drop("__lo2", "__hi2")


def crossings_down(df: DataFrame, a: str, b: str) -> DataFrame:
    """Per symbol how often a falls below b."""
    df = df.withColumn("__f", F.coalesce(F.col(a) < F.col(b), F.lit(False)))
    new = F.col("__f") & ~F.coalesce(F.lag("__f").over(W.w()), F.lit(False))
    return df.withColumn("__n", new.cast("int")).groupBy("symbol").agg(F.sum("__n").cast("bigint").alias("crossings"))


def at_rows(bars: DataFrame, places: DataFrame, columns: Sequence[str]) -> DataFrame:
    """places(symbol, rn, ...) -> with the columns of the bar of that number."""
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("dt")).cast("bigint")
    return places.join(bars.select("symbol", n.alias("rn"), *columns), ["symbol", "rn"])


@dataclass(frozen=True)
class Feature:
    """A named step: the columns it needs, those it makes, and whether it reads later rows."""

    makes: tuple[str, ...]
    build: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ("symbol", "dt", "open", "high", "low", "close", "volume")
    lookahead: bool = False


REGISTRY: dict[str, Feature] = {
    "macd": Feature(("dif", "dea", "macd"), I.macd_frame),
    "kdj": Feature(("k", "d", "j"), I.kdj_frame),
    "rsi": Feature(("rsi_6", "rsi_12", "rsi_24"), I.rsi_frame),
    "atr": Feature(("atr",), I.atr_frame),
    "ma_system": Feature(tuple(f"ma{n}" for n in I.MA_LENGTHS), I.ma_system),
    "macd_cross": Feature(("cross", "state", "turnover"), I.macd_cross, lookahead=True),
}


def resolved(bars: DataFrame, names: Sequence[str], streaming: bool = False) -> DataFrame:
    """Features in one chain, each once; a feature whose columns are there is left out. Features that read later rows are
    refused for streams."""
    df = bars
    for name in dict.fromkeys(names):
        f = REGISTRY[name]
        if streaming and f.lookahead:
            raise ValueError(f"{name} reads later rows")
        lack = [c for c in f.needs if c not in df.columns]
        if lack:
            raise ValueError(f"{name} needs {lack}")
        if not set(f.makes) <= set(df.columns):
            df = f.build(df)
    return df
