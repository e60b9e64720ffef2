"""Date-level market votes, screens of features and relative-strength rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import window as W

UPRISING = (0.1236, 0.0927)

# Columns of the market table whose rise or fall votes.
RISING = ("VOLUME_FLOW_BOOST", "VOLUME_FLOW_BOOST_BONUS", "BOOTSTRAP_I", "TALIB_PATTERNS", "FLU_POSITIVE", "ML_FLU_TREND", "ADXm_Trend", "Volume_HMA5")
FALLING = ("MAXFACTOR_CROSS", "DUAL_CROSS", "DEADPOOL")


def mass_uprising(features: DataFrame, lag_one: str, powers: Sequence[str]) -> DataFrame:
    """Per date the share of symbols that have just turned, its state against the two thresholds, and power medians."""
    rows = features.where(F.col(powers[0]).isNotNull()) if powers else features
    day = rows.groupBy("dt").agg(F.count("*").alias("n"), F.avg((F.col(lag_one) == 1).cast("int")).alias("share"), *[F.median(p).alias(p) for p in powers])
    return day.withColumn("state", F.when(F.col("share") > UPRISING[0], 1).when(F.col("share") > UPRISING[1], 2).otherwise(0))


def mass_trend(features: DataFrame, powers: Sequence[str], line: str, price: str = "close") -> DataFrame:
    """Per date: 1 most power medians positive and most symbols above their line, 2 one of both after a day of 1, 3 neither
    after a day of 1, else 0."""
    day = features.groupBy("dt").agg(
        F.count("*").alias("n"), F.avg((F.col(price) > F.col(line)).cast("int")).alias("above"), *[F.median(p).alias(p) for p in powers]
    )
    up = sum((F.coalesce((F.col(p) > 0).cast("int"), F.lit(0)) for p in powers), F.lit(0)) * 2 > len(powers)
    over = F.coalesce(F.col("above") > 0.5, F.lit(False))
    w = Window.orderBy("dt")  # one row for each date
    day = day.withColumn("full", up & over)
    before = F.coalesce(F.lag("full").over(w), F.lit(False))
    return day.withColumn("trend", F.when(F.col("full"), 1).when(before & (up | over), 2).when(before, 3).otherwise(0)).drop("full")


def attach_trend(features: DataFrame, trend: DataFrame) -> DataFrame:
    """Date-level columns to the rows of their date."""
    return features.join(trend, "dt", "left")


def since_turn(df: DataFrame, trend: str = "trend") -> DataFrame:
    """Bars since the trend became 1, the close there and the log return since. Needs rn."""
    turn = (F.col(trend) == 1) & (F.coalesce(W.lag(trend), F.lit(0)) != 1)
    df = df.withColumn("__turn", turn)
    df = df.withColumns({"age": W.bars_since(F.col("__turn")), "checkout": W.last_at(F.col("__turn"), "close")})
    return df.withColumn("since_log", F.ln(F.col("close") / F.col("checkout"))).drop("__turn")


def market_vote(market: DataFrame) -> DataFrame:
    """market(dt, total and the breadth columns) -> adds missive_dif, massive_trend, master_stream, massive_flu.

    All windows run over the dates in one order: a table of one row for each date, bounded by the calendar. The quantiles
    are over the whole history, so the result reads later dates: not for streams.
    """
    w = Window.orderBy("dt")
    every = Window.partitionBy()
    m = market

    def d(c: str) -> Column:
        return F.col(c) - F.lag(c).over(w)

    def pct(c: str) -> Column:
        return F.col(c) / F.nullif(F.lag(c).over(w), F.lit(0)) - 1

    zero = F.lit(0)
    m = m.withColumns({"flu_ratio": F.col("FLU_POSITIVE") / F.col("total"), "master_ratio": F.col("FLU_POSITIVE_MASTER") / F.col("total")})
    m = m.withColumns({
        "__vfb": F.coalesce(d("VOLUME_FLOW_BOOST") + d("VOLUME_FLOW_BOOST_BONUS"), zero),
        "__atr": F.coalesce(d("ATR_Stopline") + d("ATR_SuperTrend"), zero),
        "missive_dif": sum((F.coalesce(F.signum(d(c)), zero) for c in ("flu_ratio", "master_ratio", *RISING)), zero)
        - sum((F.coalesce(F.signum(d(c)), zero) for c in FALLING), zero),
        "__dmax": F.coalesce(d("MAXFACTOR_CROSS"), zero), "__dvfb": F.coalesce(d("VOLUME_FLOW_BOOST"), zero),
    })
    m = m.withColumns({"__ldif": F.coalesce(F.lag("missive_dif").over(w), zero), "__lvfb": F.coalesce(F.lag("__vfb").over(w), zero)})

    def cascade(ratio: str, flu: str, ml: str, frame: DataFrame, out: str) -> DataFrame:
        q = lambda p: F.percentile(F.col(ratio), F.lit(p)).over(every)  # noqa: E731  whole history: a look-ahead column
        f = frame.withColumns({
            "__q382": q(0.382), "__q618": q(0.618), "__q809": q(0.809), "__med": F.median(ml).over(every),
            "__m4r": F.avg(ratio).over(w.rowsBetween(-3, 0)), "__m4l": F.avg(ml).over(w.rowsBetween(-3, 0)),
            "__lflu": F.lag(flu).over(w), "__lml": F.lag(ml).over(w), "__pflu": pct(flu), "__pml": pct(ml),
        })
        total, vfb, vol = F.col("total"), F.col("__vfb"), F.col("VOLUME_FLOW_BOOST")
        weak = (F.col("MAXFACTOR_CROSS") < 0) | (F.col("__ldif") < 0) | (F.col("__dmax") / total < -0.168)
        r, dif = F.col(ratio), F.col("missive_dif")
        floor = F.greatest(F.lit(0.512), F.col("__q618"))
        trend = (
            F.when((r < F.greatest(F.lit(0.382), F.col("__q382"))) & (F.col("__atr") < 0), -1)
            .when(vfb / total < -0.168, -2)
            .when((F.col("__dvfb") < 0) & (vol < 0) & weak, -3)
            .when(vfb / total > 0.309, 1)
            .when(((vfb + F.col("__lvfb")) / total > 0.309) & (vfb / total > 0.168), 2)
            .when(((vol + F.col("VOLUME_FLOW_BOOST_BONUS")) / total > 0.0618) & (vol > 0) & (vfb > 0), 3)
            .when((r < floor) & (F.col("__m4r") < floor) & (F.col("__m4l") < 0) & (F.col(ml) < F.col("__med")) & weak, -4)
            .when((r < F.col("__q382")) & weak, -5)
            .when((r > F.col("__q809")) & (F.col(ml) > F.col("__med")), 4)
            .when((F.col(flu) <= F.col("__lflu")) & (F.col(ml) < F.col("__lml")) & weak, -6)
            .when((F.col("__pflu") < 0) & (F.col("__pml") < 0), -7)
            .when((F.col("__pflu") > 0) & (dif > 0) & (vol > 0), 5)
            .when((F.col("__pml") > 0) & (dif > 0) & (vol > 0), 6)
            .when(vol < 0, -8)
            .when(dif > 0, 9)
            .when((dif < 0) & weak, -9)
            .when((F.col("__dmax") < 0) & ((F.col("__ldif") < 0) | (dif < 0)), -11)
            .otherwise(0)
        )
        temp = [c for c in f.columns if c.startswith("__") and c not in ("__vfb", "__atr", "__dmax", "__ldif", "__lvfb", "__dvfb")]
        return f.withColumn(out, trend).drop(*temp)

    m = cascade("flu_ratio", "FLU_POSITIVE", "ML_FLU_TREND", m, "massive_trend")
    m = cascade("master_ratio", "FLU_POSITIVE_MASTER", "massive_trend", m, "master_stream")
    m = corrected(m)
    return m.drop("__vfb", "__atr", "__dmax", "__ldif", "__lvfb", "__dvfb")


def corrected(m: DataFrame) -> DataFrame:
    """Adds massive_flu: the two streams' common verdict, then seven corrections in their order, each of which looks back at
    what the one before it has left. A null comparison doesn't hold."""
    w = Window.orderBy("dt")  # one row for each date
    lag: Callable[..., Column] = lambda c, k=1: F.lag(c, k).over(w)
    every = lambda *xs: F.coalesce(reduce(Column.__and__, xs), F.lit(False))
    one = lambda *xs: reduce(Column.__or__, [F.coalesce(x, F.lit(False)) for x in xs])
    c = F.col
    factor, dual, dif, total = c("MAXFACTOR_CROSS"), c("DUAL_CROSS"), c("missive_dif"), c("total")
    trend, stream = c("massive_trend"), c("master_stream")
    macd, delta, dea, crowd = c("MACD"), c("MACD_DELTA"), c("DEA"), c("CLUSTER_GROUP_TOWARDS")
    day, minute = ("BOLL_RENKO", "BOOTSTRAP_GROUND_ZERO"), ("BOLL_RENKO_MINOR", "BOOTSTRAP_GROUND_ZERO_MINOR")
    before = lag("MAXFACTOR_CROSS")
    apart = F.when(trend == 0, stream < 0).otherwise(stream / F.nullif(trend, F.lit(0)) < 0.0002)
    told = F.when(dif > 0, 10).when(dif < 0, F.when(every(factor > 0, before > 0), 12).otherwise(-10)).otherwise(0)
    m = m.withColumn("massive_flu", F.when(every(apart), told).otherwise(trend))
    fades = one(delta < 0, every(lag("MACD_DELTA") < 0, before < 0))
    held = F.collect_list("PEAK_OPEN").over(w.rowsBetween(-20, 0))
    m = m.withColumn("PEAK_OPEN_RANK", F.when(F.size(held) == 21, F.size(F.filter(held, lambda v: v <= c("PEAK_OPEN"))) / 21.0))

    def v(k: int = 0) -> Column:
        return lag("massive_flu", k) if k else c("massive_flu")

    strong = lambda x: x / total > 0.809
    steps: list[tuple[int, Callable[[], Column]]] = [
        (13, lambda: every(v() == -4, factor > 0, before > 0, lag("massive_trend", 2) > 0, one(factor - before > 0, dif > 0))),
        (-99, lambda: every(v(1) < 0, v(2) > 0, factor < 0, before < 0, lag("DUAL_CROSS") > dual)),
        (11, lambda: every(v() <= 0, one(v(1) > 0, every(strong(factor), strong(before)), every(v(2) > 0, strong(factor))), dea > 0, delta > 0, factor > 0, one(factor / total > 0.618, c(minute[1]) > 0))),
        (12, lambda: every(v() <= 0, one(v(1) > 0, macd > 0), v(2) > 0, lag("MACD_DELTA") > 0, lag("MACD_DELTA", 2) > 0, dea > 0, delta > 0, factor > 0, dual > 0, crowd < 0)),
        (-98, lambda: every(v() >= 0, factor < 0, dual < 0, fades, macd < 0, one(every(*[c(x) < 0 for x in day]), every(*[c(x) < 0 for x in minute])))),
        (-97, lambda: every(v() >= 0, factor < 0, fades, one(dual < 0, macd < 0), *[c(x) < 0 for x in (*day, *minute)])),
        (13, lambda: every(v() <= 0, sum((lag("PEAK_OPEN", k) for k in (2, 3, 4)), lag("PEAK_OPEN")) > 0, c("PEAK_OPEN") < -0.0168, dea > 0, c("PEAK_OPEN_RANK") < 0.1236, crowd / total > 0.168)),
    ]
    for code, holds in steps:
        m = m.withColumn("massive_flu", F.when(holds(), code).otherwise(c("massive_flu")))
    return m
