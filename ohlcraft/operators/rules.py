"""Rule catalogues as data: value, predicate over named feature columns, and what applies them.

Predicates are SQL text over the columns that features() of plans.q_rules lists. A null comparison doesn't hold.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import window as W
from . import indicators as I
from .relational import last_match_wins


class Rule(NamedTuple):
    """value where the predicate holds; open: only where no rule has set a value. `prev` in a predicate is the value of the
    bar before, as the rules before this one left it."""

    value: int
    predicate: str
    open: bool = False


# The rules of the MACD trend, in their order.
_FADING = "(zen_sx <= 1 or renko_s + renko_l < 0 or dea < 0 or prev < 0)"
_LASTING = "(zen_sx > 4 or prev > 0)"
_ZEN_DOWN, _ZEN_UP = "zen_sx < zen_jx", "zen_jx < zen_sx"
_LINE_DOWN, _LINE_UP = "lr_sx < lr_jx", "lr_jx < lr_sx"
_BRICKS_DOWN, _BRICKS_UP = "renko_s < 0 and renko_l < 0", "renko_s > 0 and renko_l > 0"
_BEAR = "ma90 < ma120 and ma30 < ma90 and (line < ma30 or (line < ma90 and density_sma < 0.512))"
_WEAK = "(z21_1 > z21 or clear90 < -0.382 or prev < 0)"
MACD_TREND: tuple[Rule, ...] = (
    Rule(-1, f"dea > 0 and macd_jx > boll_sx and (macd > 0 or macd_sx < 4) and {_LINE_DOWN} and factor < 0 and (dual_jx < 0 or flow_tri < 0)"),
    Rule(-1, f"{_ZEN_DOWN} and {_LINE_DOWN} and {_FADING} and macd_delta < 0"),
    Rule(-1, f"boll_ub_1 > boll_ub and {_FADING} and macd_delta < 0"),
    Rule(-1, f"{_ZEN_DOWN} and {_LINE_DOWN} and {_BRICKS_DOWN} and macd_delta < 0"),
    Rule(-1, f"{_ZEN_DOWN} and {_LINE_DOWN} and {_BRICKS_DOWN} and dea < 0"),
    Rule(-1, "dif < dea and dif < dif_1 and macd_delta < 0"),
    Rule(-1, "dif < dea and dea < 0 and dif < dif_1 and macd_delta < 0"),
    Rule(1, f"{_ZEN_UP} and {_LINE_UP} and {_LASTING} and dea > 0 and macd_delta > 0"),
    Rule(1, f"{_ZEN_UP} and {_LINE_UP} and {_LASTING} and {_BRICKS_UP} and macd_delta > 0"),
    Rule(1, f"{_ZEN_UP} and {_LINE_UP} and {_LASTING} and {_BRICKS_UP} and dea > 0"),
    Rule(-1, f"{_BEAR} and {_ZEN_DOWN}"),
    Rule(-1, f"{_BEAR} and dif + 2 * macd < 0 and clear90 < 0.512 and ma30_1 > ma30 and (line_1 > line or boll_ub_1 > boll_ub) and {_WEAK}"),
    Rule(-1, f"{_BEAR} and clear90 < 0.512 and {_WEAK} and boll_channel < 0.0927"),
    Rule(-1, "ma90 < ma120 and line < ma120 and ma30 < ma120 and macd < 0 and (z21_1 > z21 or (boll_delta < 0 and dea > 0) or clear90 < -0.382 or prev < 0) and (boll_channel < 0.0927 or boll_delta < 0)"),
    Rule(1, "dif > dea and dea > 0 and dif > dif_1 and macd_delta > 0", True),
    Rule(-1, f"(macd < 0 or dea < 0) and {_ZEN_DOWN}", True),
    Rule(-1, f"prev < 0 and {_ZEN_DOWN}", True),
    Rule(1, f"{_ZEN_UP} and boll_jx < boll_sx and macd_delta > 0", True),
    Rule(1, f"{_ZEN_UP} and dea > 0 and ma120 < ma90 and boll < atr_lb", True),
    Rule(-1, "combo < 0 and tide_sx > 0 and macd < 0", True),
    Rule(-1, f"macd < 0 and dea > 0 and (boll_sx > macd_sx or renko_s < 0) and (density_sma < 0.512 or combo < 0) and {_ZEN_DOWN}", True),
)
#: Holds against all rules: a run of the dual cross above a rising MACD.
MACD_SUPER = "dual_jx > 0 and macd > 0 and dea > 0 and higher_settle"

# Signals that vote on leverage by their sign, in their order, and the unit of a vote.
LEVERAGE_SIGNALS = ("lr_cross", "factor", "dual", "atr_stop", "supertrend", "vhma_dir", "combo", "renko_l", "renko_s", "renko", "ml_trend", "cluster", "patterns")
UNIT = 0.0309
BOOTSTRAP_UNITS = {"first": 2.0, "second": 1.236, "dead": -2.0}


def _holds(predicate: str) -> Column:
    return F.coalesce(F.expr(predicate), F.lit(False))


def cascade(df: DataFrame, rules: Sequence[Rule], seed: Column, out: str) -> DataFrame:
    """Rules in their order, each over what those before it left. Needs rn."""
    df = df.withColumn(out, seed)
    for r in rules:
        if "prev" in r.predicate.split() or "prev <" in r.predicate or "prev >" in r.predicate:
            df = df.withColumn("prev", F.coalesce(W.lag(out), F.lit(0)))
        hit = _holds(r.predicate) & (F.col(out) == 0) if r.open else _holds(r.predicate)
        df = df.withColumn(out, F.when(hit, r.value).otherwise(F.col(out))).drop("prev")
    return df


def macd_trend(features: DataFrame) -> DataFrame:
    """Adds macd_trend in -1, 0, 1: the bar of a MACD cross, then the rules, then what holds against them."""
    seed = F.when(F.col("macd_sx") == 0, -1).when(F.col("macd_jx") == 0, 1).otherwise(0)
    df = cascade(features, MACD_TREND, seed, "macd_trend")
    return df.withColumn("macd_trend", F.when(_holds(MACD_SUPER), 1).otherwise(F.col("macd_trend")).cast("bigint"))


def leverage_delta(f: DataFrame) -> DataFrame:
    """Adds leverage_delta: votes of a UNIT each where price and RSI move the same way, then the flip of a bear alignment
    and the penalty of a falling slope."""
    up, down = (_holds(f"pct {s} 0 and rsi_delta {s} 0") for s in "><")

    def vote(rise: str, fall: str, k: float = 1.0, j: float = 1.0) -> Column:
        return F.when(up & _holds(rise), k * UNIT).when(down & _holds(fall), -j * UNIT).otherwise(0.0)

    votes = [vote(f"{c} > 0", f"{c} < 0") for c in LEVERAGE_SIGNALS]
    first, second, dead = (BOOTSTRAP_UNITS[k] * UNIT for k in ("first", "second", "dead"))
    votes.append(F.when(up & _holds("bootstrap_1"), first).when(down & _holds("bootstrap_2"), second).when(down & _holds("deadpool"), dead).otherwise(0.0))
    votes.append(vote("tri_jx > 0", "tri_sx < 0"))
    votes.append(F.when(up & _holds("boost > 0"), UNIT).when(down & _holds("boost < 0"), -UNIT).when(up & _holds("bonus"), UNIT).otherwise(0.0))
    votes += [vote("flu_up > 0", "flu_down > 0"), vote("master_up > 0", "master_down > 0")]
    df = f.withColumn("__v", sum(votes, F.lit(0.0)))
    bear = _holds("ma90 < ma120 and ma30 < ma90 and (dea < 0 or density < 0.5)") & (_holds("macd_delta < 0 and boll_sx < boll_jx") | down)
    df = df.withColumn("__v", F.when(bear, -F.abs("__v") - UNIT).otherwise(F.col("__v")))
    df = df.withColumns({"__s4": W.sma("dea_slope", 4), "__m4": W.sma("macd", 4)})
    falling = _holds("__s4 < 0 and __m4 < 0 and density_sma < 0.512") & ~_holds("boot_before > macd_sx")
    return df.withColumn("leverage_delta", F.when(falling, F.col("__v") - 2 * UNIT).otherwise(F.col("__v"))).drop("__v", "__s4", "__m4")


def smart_leverage(f: DataFrame) -> DataFrame:
    """leverage_delta and the position held in [0, 1] from it, with the position of the bar before."""
    return I.smart_leverage(leverage_delta(f), "leverage_delta")


# Labels of the screens over the feature table and their predicates.
SCREENS: dict[str, str] = {
    "fullstack": "fullstack_lag > 0 and downrisk_lag > 0",
    "halfstack": "halfstack_lag > 0 and downrisk_lag > 0",
    "downrisk": "downrisk_lag < 0",
    "saltedfish": "(regtree_lag < -400 or regtree_lag > 400) and hma10 < 9.27",
    "groundzero": "ground_zero_lag > 0 and dash_returns > 0.0002",
    "combo": "combo_lag in (1, 2, -1, -2, -3, -4)",
    "buylong": "(ground_zero_lag > 0 and ground_zero) or (poly9_empirical > 0 and ground_zero_lag > 0 and dash_lag > 0 and dash_lag <= 12 and macd_zero_lag < 0 and drawdown_ratio - drawdown_ratio_major < 0.382) or bootstrap_1",
    "sellshort": "endpoints < 0 or endpoints_before < 4",
    "short": "ground_zero_lag < 0",
    "hyperpunch": "mapower30_lag_major > 0 and mapower30_lag_major > hmapower120_lag_major and ((atr_lb > poly9_checkout_atr_lb and peak_lag > mapower30_lag_major)"
    " or (atr_lb > mapower30_checkout_atr_lb and mapower30_low_before > mapower30_lag_major and boll_lb_hma5_lag > mapower30_lag_major and (atr_lb > poly9_checkout_atr_lb or mapower30_low_before + poly9_checkout_lag < 0)))",
}
#: Tag of the weak: below the quarter of all rows' regression-tree lags, or below the fixed one where that quarter isn't low.
WEAKSHORT = "regtree_lag < {cut} and drawdown_ratio_major < 0.84 and boll_lb_hma5_lag < macd_jx"
WEAK_QUARTER, WEAK_FROM, WEAK_FIXED = 0.25, -36, -72


def screened(features: DataFrame) -> DataFrame:
    """Adds tags: all labels of a row, comma-joined; rows without one go. The quarter is one row over all rows of features."""
    quarter = features.agg(F.percentile("regtree_lag", F.lit(WEAK_QUARTER)).alias("__q"))
    cut = F.when(F.col("__q") < WEAK_FROM, F.col("__q")).otherwise(float(WEAK_FIXED))
    df = features.crossJoin(F.broadcast(quarter)).withColumn("__cut", cut)  # one row
    labels = {"weakshort": WEAKSHORT.format(cut="__cut")} | SCREENS
    tags = F.concat_ws(",", *[F.when(_holds(p), F.lit(k)) for k, p in labels.items()])
    return df.withColumn("tags", tags).where("tags <> ''").drop("__q", "__cut")


# The rules of relative strength, in their order. `name@k` is the value of the column k bars before.
def _no(predicate: str) -> str:
    return f"not coalesce({predicate}, false)"


SPIKE = (
    "((ma5 > open and macd < 0) or (renko_ub < close and bias3 > bias3@1 and macd < 0) or (renko_s > 0 and bias3 > bias3@1 and macd < 0) or macd > 0)"
    f" and {_no('dea_slope < 0 and macd < 0 and factor < 0 and ma5 < open')}"
)
_TIRED = "dea > 0 and (tide_sx >= factor_jx + 4 or factor + dual < 0)"
_HOT = _no(f"z21 + z84 > 1 and {_TIRED}")
_SINKING = _no("macd < 0 and bias3 < 0 and macd_delta < 0")
_STEEP = "((slope > ma30_slope and sx_dea > 0) or ma30_slope > ma90_slope or (ma90_slope > ma120_slope and dea > 0))"
_LIFT21, _LIFT84, _LIFT3 = "z21@1 <= z21", "z84@1 <= z84", "bias3@1 < bias3"
_UP21, _UP84, _UPZ = "z21@1 < z21", "z84@1 < z84", "bias3_z@1 < bias3_z"
_AGED = (
    "((boll_jx > 36 and dif > 0) or (boll_jx <= 2 and zen_sx > 18 and dif > 0) or (dea_jx > 36 and clear90 > 1.236 and dif > 0)"
    " or (boll_jx > dea_jx and clear90 > 1.236 and dif > 0) or (boll_jx < boll_sx and boot_before < macd_sx))"
)
_BASE = "((neg_lower and (sx_dea > 0 or density_8 > 0.512)))"
_START = (
    "((boot_before < macd_sx and (dea < 0 or (dea_jx < macd_jx and dea > 0 and macd > 0)))"
    " or (dea > 0 and boot2_before < dea_jx and (macd_sx <= 6 or (renko_l > 0 and (renko_s > 0 or renko_before <= 8)) or (macd > 0 and macd_jx > 8)) and renko_l > 0 and renko_s > 0))"
)
_FRESH = "factor > 0 and factor@1 < 0 and bias3_z < 0.93 and bias3 > 0 and ((bias3@1 > 0 and bias3@3 > 0 and bias3@5 > 0 and bias3@7 > 0) or bias3@1 < 0)"
_TREND3 = "dea > 0 and ma5 > boll and ma10 > boll and boll > ma30 and ma30 > ma90"
_FALLS = "(lr_sx < lr_jx or boll_delta < 0 or factor < 0) and boll_sx < boll_jx"
_ODDZ = "(bias3_z > 0.168 or bias3_z < 0.0512)"
_RISES = _no(f"{_LIFT3} and {_UPZ} and {_UP21} and {_UP84}")
_BULL = "(factor_jx < 6 or (macd_trend > 0 and macd_trend@1 > 0)) and line > ma90"
STRENGTH_BUY: tuple[tuple[int, str], ...] = (
    (1, f"(factor_jx < 6 or (bias3@1 < 0 and z21@1 < 0.382 and {_LIFT3})) and z21 < 0.809 and bias3_z < 0.93 and {{spike}} and {_no(f'z21@1 + z84@1 > 1.1 and {_TIRED}')} and {_LIFT21}"
        f" and (z21@1 < 0.382 or z21 < 0.382 or (z21_8 < 0.512 and dea < 0 and sx_dea > 0 and z21_4 < 0.618)) and (dea > 0 or {_BASE} or (dea < 0 and boot_before < macd_sx))"
        f" and (dual + flow_tri >= 0 or ({_STEEP} and {_BASE} and macd_delta > 0)) and {_SINKING}"),
    (2, f"(factor_jx < 6 or dual_jx >= 4) and z21 < 0.809 and {_HOT} and {_LIFT21} and (z21@1 < 0.382 or z21 < 0.382) and density_8 > 0.618 and {{spike}} and dea > 0 and dea_slope > 0"),
    (3, f"(factor_jx < 6 or dual_jx >= 4) and z21 < 0.809 and {_HOT} and {_LIFT21} and (z21@1 < 0.512 or z21 < 0.512) and density_8 > 0.618 and {_LIFT84}"
        f" and (z84@1 < 0.512 or z84 < 0.512 or (dual + flow_tri >= 0 and sx_dea > 0)) and dea > 0 and {{spike}} and {_STEEP}"),
    (4, f"factor_jx < 6 and z21 < 0.809 and {_HOT} and {_LIFT21} and (z21@1 < 0.382 or z21 < 0.382) and neg_lower@1 and density_8 > 0.512"),
    (5, f"(factor_jx < 6 or dual_jx >= 4 or bootstrap_1) and z21 < 0.809 and {_HOT} and bias3_z < 0.93 and {_LIFT21} and (z21@1 < 0.382 or z21 < 0.382) and {_LIFT84} and (z84@1 < 0.382 or z84 < 0.382) and {_STEEP} and {_SINKING}"),
    (6, f"((boll_sx <= 8 and clear90 > -0.618 and clear90 < 0.382) or (boll_jx <= 1 and macd < 0 and dea > 0)) and (factor_jx < 4 or macd > 0 or (bias3@1 < 0 and bias3 > 0 and {_LIFT3}))"
        f" and z21@1 < 0.382 and z84@1 < 0.382 and {_LIFT21} and {_LIFT84} and {_AGED}"),
    (7, f"boll_sx <= 8 and clear90 > 1.236 and macd_sx <= 6 and macd < 0 and bias3@1 < 0 and bias3 > 0 and {_LIFT3} and z21@1 < 0.9 and z84@1 < 0.9 and {_LIFT21} and {_LIFT84}"
        f" and {_no('bias3@1 < 0 and macd < 0 and maxfactor < 0 and factor < 0')} and {_AGED}"),
    (10, "(clear90 > 1.236 or (clear90 > 0.809 and bias3_z < 0.382)) and bias3@1 > 0 and bias3@3 > 0 and bias3@5 > 0 and bias3@7 > 0 and {spike} and ((macd_sx <= 6 and (ma5 > open or zen_jx < zen_sx) and macd < 0) or macd > 0)"
         f" and (bias3_z@1 < bias3_z or bias3_z@2 < bias3_z or bias3_z@3 < bias3_z) and bias3 > 0 and bias3 < 9.27 and factor > 0 and (factor@1 < 0 or factor@2 < 0) and {_AGED}"),
    (11, f"clear90 > -0.618 and clear90 < 0.309 and factor > 0 and factor_jx <= 6 and bias3 > -9.27 and bias3@1 < 0 and bias3_z@1 < 0.382 and {_UPZ} and z21@1 < 0.382 and {_UP21} and z84@1 < 0.382 and {_UP84}"
         " and macd_delta > 0 and boll_delta > 0 and (lr_jx < lr_sx or factor_jx < 4) and macd < 0 and macd + macd_delta * 8 > 0"),
    (12, f"clear90 > -0.618 and clear90 < 0.309 and factor > 0 and factor_jx <= 8 and (trigger@1 > 0 or trigger@2 > 0 or trigger@3 > 0 or trigger@4 > 0) and bias3 > -9.27 and bias3@1 < 0 and {_LIFT3} and bias3_z < 0.93"
         f" and bias3_z@1 < 0.809 and {_UPZ} and z21@1 < 0.809 and {_UP21} and z84@1 < 0.512 and {_UP84} and macd_delta > 0 and (boll_delta > 0 or macd_jx < 2) and (lr_jx < lr_sx or factor_jx < 4)"),
    (13, "clear90 > -0.382 and clear90 < 0.618 and bias3@3 > 0 and bias3@4 > 0 and bias3_z < 0.382 and bias3_z@1 < 0.382 and bias3_z@2 < 0.382 and z21 < 0.382 and z21@1 < 0.382 and z21@2 < 0.382"
         " and z84 < 0.382 and z84@1 < 0.382 and z84@2 < 0.382 and (lr_jx < lr_sx or factor_sx <= 8) and macd < 0 and macd_sx <= 8"),
    (14, f"{_START} and {_FRESH} and (macd_delta > 0 or (macd_jx > 8 and macd > 0)) and (boll_delta > 0 or (bias3 > 0 and bias3@1 < 0))"),
    (15, f"{_START} and {_FRESH} and (lower_settle or dif > 0) and z84@1 < 0.512 and {_UPZ} and {_UP21} and {_UP84} and clear90 > -0.618 and clear90 < 0.382"),
    (16, f"{{spike}} and macd > 0 and ma5 > open@1 and (bias3_z < 0.93 or renko_s@1 < 0) and ((maxfactor@2 > 0 and maxfactor@3 > 0) or (maxfactor@3 > 0 and maxfactor@4 > 0)) and macd_delta@1 < macd_delta"
         f" and maxfactor@1 < maxfactor and renko_ub@1 < renko_ub and renko_ub@2 < renko_ub and {_LIFT3} and ({_UPZ} or (bias3_z@1 <= bias3_z and maxfactor@1 < 0)) and {_UP21} and {_UP84} and clear90 > 0.618"),
    (17, "{spike} and renko_ub < close and (macd < 0 or (macd_delta > 0 and maxfactor > 0 and maxfactor@1 < 0)) and (boll_sx <= 4 or factor_jx <= 1) and (renko_before > 1 or (renko_ub > renko_ub@1 and (macd < 0 or maxfactor < 0)))"),
    (18, "{spike} and macd < 0 and dea > 0 and renko_s > 0 and (rsrs_held > 0 or rsrs > 0) and ma5 > open@1 and factor_jx = 0"),
    (19, "{spike} and renko_l > 0 and dea > 0 and macd < 0 and rsrs > 0 and zen_jx = 0 and factor > 0 and maxfactor > 0 and (bias3 > 0 or macd_delta > 0)"),
    (8, f"{_BULL} and ma90 > ma120 and clear120 < 1.236 and (factor_jx < 4 or bias3@1 < 0) and bias3 > 0 and {{spike}} and {_LIFT3} and z21@1 < 0.382 and z21 < 0.512 and {_LIFT21} and {_LIFT84} and {_AGED}"),
    (9, f"{_BULL} and (ma90 > ma120 or (line > ma120 and ma30_slope > baseline_slope)) and (factor_jx < 4 or macd > 0 or (bias3@1 < 0 and bias3 > 0 and {_LIFT3})) and z21@1 < 0.382 and z84@1 < 0.382 and {_LIFT21} and {_LIFT84} and {_AGED}"),
)
STRENGTH_SELL: tuple[tuple[int, str], ...] = (
    (-1, f"atr_cross <= 0 and {_no(f'factor > 0 and bias3 > 0 and {_LIFT21} and {_LIFT84}')} and {_no('dual_jx > 0 and flow_tri > 0')} and macd > 0 and macd_delta < 0 and zen_sx < zen_jx and bias3_z@1 < 0.96"),
    (-2, f"{_TREND3} and pct@1 < 0 and (pct@2 < 0 or pct@3 < 0 or pct@4 < 0) and macd_delta < 0 and {_no('macd_sx < 4 and z21 > 0.809 and z84 > 0.809')} and {_FALLS} and {_ODDZ}"),
    (-3, f"{_TREND3} and pct@2 < 0 and (pct@3 < 0 or pct@4 < 0 or pct@5 < 0) and macd_delta < 0 and {_FALLS} and {_ODDZ}"),
    (-4, f"renko_s < 0 and {_no('dual_jx > 0 and flow_tri > 0')} and {_no('bias3@1 < 0 and bias3 > 0')} and {_no('pct > 0')} and trigger <> 1 and {_no(f'{_LIFT3} and {_UP21} and {_UP84}')} and dual_jx < 1 and macd > 0"
         " and ((renko_sx < 8 and zen_sx < 24) or zen_sx < zen_jx)"),
    (-5, f"{_TREND3} and factor@1 < 0 and (factor@2 < 0 or factor@3 < 0 or factor@4 < 0) and factor < 0 and {_FALLS} and {_ODDZ} and {_RISES}"),
    (-6, f"{_TREND3} and factor@2 < 0 and (factor@3 < 0 or factor@4 < 0 or factor@5 < 0) and factor < 0 and {_FALLS} and {_ODDZ} and {_RISES}"),
    (-7, f"dea > 0 and bias3 < 0 and macd < 0 and macd_delta < 0 and factor@1 < 0 and (factor@2 < 0 or factor@3 < 0 or factor@4 < 0) and factor < 0 and lr_sx < lr_jx and {_ODDZ} and {_RISES}"),
)
STRENGTH_VETO, VETOED = "maxfactor > 0 and bias3 > 0 and macd > 0 and zen_sx > 4 and (renko_ub@1 < renko_ub or (renko_ub < close and renko_ub > low3))", -666
_AT = re.compile(r"(\w+)@(\d)")


def lags_of(predicates: Sequence[str]) -> list[tuple[str, int]]:
    """Columns that the predicates look back at, and how far."""
    return sorted({(c, int(k)) for p in predicates for c, k in _AT.findall(p)})


def plain(predicate: str) -> str:
    """A predicate over columns that hold the earlier values."""
    return _AT.sub(r"\1__\2", predicate.replace("{spike}", "spike"))


def strength(features: DataFrame) -> DataFrame:
    """Adds trigger: the last buy rule that holds, else the last sell rule, else 0, a vetoed sell VETOED; and its timing lag,
    the signed run of which of both came last."""
    cut = next(i for i, (k, _) in enumerate(STRENGTH_BUY) if k == 12)
    every = [p for _, p in (*STRENGTH_BUY, *STRENGTH_SELL)] + [STRENGTH_VETO, SPIKE]
    df = features.withColumns({f"{c}__{k}": W.lag(c, k) for c, k in lags_of(every) if c != "trigger"})
    df = df.withColumn("spike", _holds(plain(SPIKE)))

    def last(rules: Sequence[tuple[int, str]], default: Column) -> Column:
        return last_match_wins([(k, _holds(plain(p))) for k, p in rules], default)

    df = df.withColumn("trigger", last(STRENGTH_BUY[:cut], F.lit(0)))
    df = df.withColumns({f"trigger__{k}": F.coalesce(W.lag("trigger", k), F.lit(0)) for c, k in lags_of(every) if c == "trigger"})
    df = df.withColumn("trigger", last(STRENGTH_BUY[cut:], F.col("trigger")))
    df = df.withColumn("__s", last(STRENGTH_SELL, F.lit(0)))
    sold = F.when(_holds(plain(STRENGTH_VETO)) & (F.col("__s") < 0), VETOED).otherwise(F.col("__s"))
    df = df.withColumn("trigger", F.when(F.col("trigger") > 0, F.col("trigger")).otherwise(sold).cast("bigint"))
    df = df.withColumns({"__j": W.bars_since(F.col("trigger") > 0), "__x": W.bars_since(F.col("trigger") < 0)})
    df = df.withColumn("__p", F.signum(F.col("__x") - F.col("__j")))
    df = df.withColumn("trigger_lag", W.signed_run(F.col("__p")))
    return df.drop("__s", "__j", "__x", "__p", *[c for c in df.columns if c not in features.columns and "__" in c])


# The rules of the regression band. A symbol's own quantiles over its whole history are columns: q_<column>_<percent>.
_SIDE = "(lr2_cross = -1 or lr2_sx < lr2_jx)"
_SOLD_OFF = "boll_sx < 6 or boll_sx < macd_sx"
_LOSS = "pct < -0.0002"
_SUNK = "ma90 < ma120 and dif < 0 and clear90 > -0.382 and clear90 < 0.191 and clear_sx > 0"
_DROP = "dea > 0 and macd > 0 and macd_delta < 0 and pct < -0.0002"
BAND_QUANTILES = {"clear90": (19.1, 50), "lr2_jx": (38.2, 61.8), "lr2_sx": (38.2, 61.8), "boll_channel": (38.2,), "touched": (19.2, 38.2)}
BAND_SELL: tuple[str, ...] = (
    f"{_SIDE} and atr_ratio > 1 / 2.06 and clear90 > q_clear90_500 and lr2_jx < q_lr2_jx_382 and ({_SOLD_OFF}) and {_LOSS}",
    f"{_SIDE} and atr_ratio > 1 / 3.09 and boll_jx < 6 and {_LOSS}",
    f"lr2_cross = 1 and lr2_jx >= 8 and atr_ratio > 1 / 2.06 and clear90 > q_clear90_500 and lr2_sx < q_lr2_sx_382 and ({_SOLD_OFF}) and {_LOSS}",
    f"{_SIDE} and boll_ub < atr_ub@1 and (boll_sx < 6 or (lr2_jx > q_lr2_jx_618 and (clear90 < clear120 or lr2_cross > -1)) or ma30_sx < 6) and {_LOSS}",
    f"ma90 < ma120 and lr2_jx >= 8 and (macd < 0 or dual_sx > 0 or clear_sx < boll_jx) and {_SUNK} and {_LOSS}",
    "eject",
    f"trend2 > 0 and lr2_jx >= 8 and (boll_sx <= 1 or atr_sx <= 1) and {_DROP} and drawdown < q_touched_192",
    f"trend2 > 0 and lr2_jx >= 8 and boll_sx <= 1 and atr_sx <= 1 and {_DROP} and drawdown_4 < q_touched_192",
    f"trend2 < 0 and boll_sx >= lr2_sx and boll_sx <= boll_jx and atr_sx <= atr_jx and dea > 0 and macd < 0 and macd_delta < 0 and {_LOSS} and drawdown_4 < q_touched_382",
    f"trend2 < 0 and boll_sx >= lr2_sx and atr_ratio > 1 / 2.06 and dea > 0 and macd < 0 and macd_delta < 0 and drawdown < -0.0002 and {_LOSS}",
    f"trend2 < 0 and boll_sx >= lr2_sx and atr_ratio > 1 / 2.06 and dea < 0 and macd_delta < 0 and drawdown < -0.0002 and {_LOSS}",
)
_NEAR = (
    "((atr_jx <= boll_jx and atr_jx - lr2_jx > 6) or (lr2_jx <= boll_jx and factor_jx <= lr2_jx and atr_jx <= boll_jx) or (lr2_jx <= boll_jx and factor_jx <= lr2_jx and atr_jx - lr2_jx > 6)"
    " or (atr_jx - boll_jx < 4 and boll_jx - lr2_jx < 4) or (atr_jx - boll_jx > 6 and boll_jx - lr2_jx < 6 and lr2_jx - factor_jx <= 2))"
)
_CALM = "(drawdown > -0.0001 or pct > -0.0001)"
BAND_BUY: tuple[str, ...] = (
    f"lower_settle and clear90 < q_clear90_191 and lr2_sx > q_lr2_sx_618 and boll_jx < boll_sx and {_no(_SUNK)} and (lr2_jx >= macd_jx or macd < 0) and lr_dir > 0",
    f"atr_ratio > 1 / 3.09 and {_no(_SUNK)} and lower_settle and lr_dir > 0",
    f"lr2_jx <= 4 and trend2 > 0 and cross_4 > 0 and {_NEAR} and {_CALM} and ma90 > line and ma90 > atr_lb",
)
_ALL_DOWN = "ma30_slope < 0 and dea_slope < 0 and slope < 0"
BAND_RISK = (
    f"{_CALM} and {_NEAR} and (open < ma30 or (under_6 > 0 and dea < 0 and (dea_slope > 0 or dif > 0)) or dea_jx <= macd_jx or dea_jx <= lr2_jx) and {_no('atr_sx <= lr2_jx')} and {_no('boll_sx <= lr2_jx')}"
    f" and {_no('boll_channel < least(0.0309, q_boll_channel_382) and (least(boll_jx - lr2_jx, atr_jx - lr2_jx) > 2 or lr2_jx > 2)')}"
    f" and {_no(f'{_ALL_DOWN} and bias3 < -9.27 and clear90 + clear120 > 0')} and {_no(f'{_ALL_DOWN} and dea < 0 and bias3 < -6.18 and clear90 + clear120 > 0')}"
)
#: A rising line that is put back to 0 in the second pass.
BAND_EJECT = (
    "((lr_dir > 0 and dea < 0 and dir_4 < 1 and atr_ratio > 0.618) or (lr_dir = 1 and lr_dir@1 = 0 and dea < 0 and dir_4 < 0 and atr_ratio > 0.618))"
    f" and {_no('atr_jx = boll_jx and boll_delta > -0.0008')}"
)
#: Rows whose drawdown makes the quantiles of `touched`.
BAND_TOUCHED = "trend2 > 0 and boll_sx <= 1 and dea > 0 and macd > 0"


def regression_band(features: DataFrame) -> DataFrame:
    """Adds band in -1, 0, 1 and the ages of both, in two passes over the line's direction. Its quantiles are over a symbol's
    whole history: not for streams."""
    every = [*BAND_SELL, *BAND_BUY, BAND_RISK, BAND_EJECT]
    df = features.withColumns({f"{c}__{k}": W.lag(c, k) for c, k in lags_of(every)} | {"dir_4": W.sma("lr_dir", 4) * 4})
    df = df.withColumn("eject", _holds(plain(BAND_EJECT)))
    df = df.withColumn("trend2", F.when((F.col("lr_dir") > 0) & ~F.col("eject"), 1).when(F.col("lr_dir") < 0, -1).otherwise(0))
    turn = F.col("trend2") - W.lag("trend2")
    df = df.withColumns({"lr2_cross": F.coalesce(F.signum(turn), F.lit(0.0)), "lr2_jx": W.bars_since(turn > 0), "lr2_sx": W.bars_since(turn < 0), "touched": F.when(_holds(BAND_TOUCHED), F.col("drawdown"))})
    df = df.withColumn("cross_4", F.sum("lr2_cross").over(W.frame(4)))
    df = df.withColumns({f"q_{c}_{round(10 * p):03d}": F.percentile(F.col(c), F.lit(p / 100)).over(W.whole()) for c, ps in BAND_QUANTILES.items() for p in ps})
    sell = reduce(Column.__or__, [_holds(plain(p)) for p in BAND_SELL])
    buy = reduce(Column.__or__, [_holds(plain(p)) for p in BAND_BUY]) & _holds(plain(BAND_RISK))
    df = df.withColumn("band", F.when(buy, 1).when(sell, -1).otherwise(0).cast("bigint"))
    return df.withColumns({"band_jx": W.bars_since(F.col("band") == 1), "band_sx": W.bars_since(F.col("band") == -1)})


# Named predicates of the feature store.
STORE: dict[str, str] = {
    "trigger": "trigger_r5 > 0",
    "position": "position_r5 > 0",
    "main_wave": "(combo_lag > 0 or ground_zero_minor_lag > 0) and (combo_returns > -0.0927 or combo_minor_returns > -0.0927) and (trigger_r5 > 0 or trigger_rps > 0)",
    "bootstrap": "(cluster < 0 or cluster_minor < 0) and (rail_lag > 0 or ground_zero_lag > 0) and ground_zero",
}

# What the selector lets go, what it keeps, and its groups in their order.
FADE = "(combo_lag < 0 and ground_zero_lag < 0 and onhold < 0) or (sharpe < 1.5 and sortino < 1.5)"
BEST = (
    "leverage > 0.99 or (trigger_rps > 80 and trigger_rps < 85) or (boll_renko_lag > 0 and boll_renko_lag <= 4) or (boll_renko_lag > 0 and trigger_rps > 0) or (trigger_rps > 0 and density > 0.5)"
    " or (trigger_rps > 0 and neg_lower and density > 0.382) or (trigger_rps > 0 and combo > 0)"
)
_OPENS = "((ground_zero_minor_lag > 0 and combo_lag > 0) or dea < 0)"
_BREAKS = "((boll_renko_lag > 0 and boll_renko_lag <= 4) or (boll_renko_lag > 0 and trigger_rps > 0))"
GROUPS: tuple[str, ...] = (
    f"{_OPENS} and neg_lower and combo_lag > 0",
    f"{_OPENS} and bootstrap_1",
    f"{_OPENS} and bootstrap_2 and ((density > 0.512 and bias3 > 0 and (bias3@1 < 0 or bias3@2 < 0 or z21@1 < z21 or z84@1 < z84)) or {_BREAKS})",
    f"{_OPENS} and trigger_rps > 0 and {_BREAKS}",
    f"{_OPENS} and (combo_lag > 0 or ground_zero_lag > 0)",
)


def stored(features: DataFrame) -> DataFrame:
    """Rows that a named predicate of the store holds for, with a flag for each."""
    flags = {k: _holds(p) for k, p in STORE.items()}
    df = features.withColumns({f"is_{k}": x for k, x in flags.items()})
    return df.where(reduce(Column.__or__, [F.col(f"is_{k}") for k in flags]))


def selected(features: DataFrame, market: DataFrame) -> DataFrame:
    """Rows that the selector keeps: their group (0 to 4 as in GROUPS, 5 the rest) and retreat, whether the market's flow
    is below 0 on their date. market(dt, flow): one row for each date."""
    df = features.withColumns({f"{c}__{k}": W.lag(c, k) for c, k in lags_of(GROUPS)})
    df = df.where(~_holds(FADE) & _holds(BEST))
    group = F.coalesce(*[F.when(_holds(plain(p)), F.lit(i)) for i, p in enumerate(GROUPS)], F.lit(len(GROUPS)))
    df = df.withColumn("grade", group.cast("bigint"))
    return df.join(market, "dt", "left").withColumn("retreat", F.coalesce(F.col("flow") < 0, F.lit(False)))
