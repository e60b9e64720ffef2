"""Back-test: holding returns, the trade state machine, order sizing and performance statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import window as W

#: Trade states.
FLAT, HELD, SUSPENDED, CLOSED, ENDED = 0, 1, 2, 3, 4
#: Bars a forecast holds, by bars of a year.
HORIZON = {252: 3, 1008: 12, 2016: 24, 12096: 72}
LEDGER = (
    "symbol long, trade int, state int, start_dt timestamp_ntz, act_dt timestamp_ntz, end_dt timestamp_ntz, long int, settle double, "
    "end_price double, ret double, ret_forecast double, ret_simulated double, bars long"
)


def onhold_returns(df: DataFrame, ret: str, position: str, out: str) -> DataFrame:
    """Sum of returns over the current holding run; the position of the bar before holds. 0 when flat. Needs rn."""
    held = F.coalesce(F.lag(position).over(W.w()), F.lit(0)) > 0
    df = df.withColumn("__held", held)
    df = df.withColumn("__run", F.sum(F.when(F.col("__held"), 0).otherwise(1)).over(W.upto()))
    run = Window.partitionBy("symbol", "__run").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.when(F.col("__held"), F.col(ret)).otherwise(0.0)).over(run)
    return df.withColumn(out, F.when(F.col("__held"), total).otherwise(0.0)).drop("__held", "__run")


def onhold_price_return(df: DataFrame, position: str, out: str, price: str = "close") -> DataFrame:
    """Return since the close at which the position was entered; null when flat."""
    entered = (F.col(position) > 0) & (F.coalesce(F.lag(position).over(W.w()), F.lit(0)) <= 0)
    entry = W.last_at(entered, price)
    return df.withColumn(out, F.when(F.col(position) > 0, F.col(price) / entry - 1))


def onhold_position(df: DataFrame, buy: str, sell: str, out: str) -> DataFrame:
    """1 while the last buy is more recent than the last sell. Needs rn."""
    df = df.withColumns({"__b": W.bars_since(F.col(buy)), "__s": W.bars_since(F.col(sell))})
    return df.withColumn(out, (F.col("__b") < F.col("__s")).cast("bigint")).drop("__b", "__s")


def run_trades(
    close: np.ndarray, trigger: np.ndarray, forecast: np.ndarray, position: np.ndarray, principle: np.ndarray | None, long: int = 1
) -> list[dict]:
    """Trades of one symbol. With a principle a trade waits, and is suspended, while principle * long <= 0; without one
    it is held from the trigger on. A trade still open at the last bar is marked to market there."""
    out: list[dict] = []
    now: dict | None = None
    for i in range(len(close)):
        good = principle is None or principle[i] * long > 0
        if now is None:
            if trigger[i] > 0:
                now = {"state": HELD if good else SUSPENDED, "start": i, "act": i if good else None, "settle": close[i] if good else None, "forecast": None}
                out.append(now)
            continue
        live = forecast[i] > 0
        if live and principle is not None:
            if now["state"] == SUSPENDED and good:
                now["state"] = HELD
                if now["act"] is None:
                    now["act"], now["settle"] = i, close[i]
            elif now["state"] == HELD and not good:
                now["state"] = SUSPENDED
        if position[i] <= 0:
            now["state"] = CLOSED if now["state"] == HELD else ENDED
            now["end"] = i
            now = None
        elif not live:
            if now["state"] == SUSPENDED:
                now["state"], now["end"] = ENDED, i
                now = None
            elif now["forecast"] is None and now["settle"]:
                now["forecast"] = (close[i] - now["settle"]) / now["settle"] * long
    for t in out:
        t["end_bar"] = t.get("end", len(close) - 1)
        end = close[t["end_bar"]]
        t["end_price"] = end
        t["ret"] = (end - t["settle"]) / t["settle"] * long if t["settle"] else None
        t["simulated"] = (end - close[t["start"]]) / close[t["start"]] * long
    return out


def ledger(df: DataFrame, trigger: str, forecast: str, position: str, principle: str | None = None, long: int = 1) -> DataFrame:
    """One row for each trade; columns of LEDGER."""
    names = [x.split()[0] for x in LEDGER.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt", kind="stable", ignore_index=True)
        arrays = [pdf[c].to_numpy(float) for c in ("close", trigger, forecast, position)]
        dt = pdf["dt"]
        rows = []
        for k, t in enumerate(run_trades(*arrays, pdf[principle].to_numpy(float) if principle else None, long)):
            act, end = t["act"], t.get("end")
            rows.append(
                (pdf["symbol"][0], k, t["state"], dt[t["start"]], None if act is None else dt[act], None if end is None else dt[end], long,
                 t["settle"], t["end_price"], t["ret"], t["forecast"], t["simulated"], t["end_bar"] - t["start"])
            )
        return pd.DataFrame(rows, columns=names)

    columns = dict.fromkeys(["symbol", "dt", "close", trigger, forecast, position, *([principle] if principle else [])])
    return df.select(*columns).groupBy("symbol").applyInPandas(run, LEDGER)


#: Sum of the clearances above which a position is built step by step and given up at once; fall of the target that ends it.
HIGH, GIVE_UP, STILL = 1.24, -0.168, 0.005


def order_positions(delta: np.ndarray, norm: np.ndarray, before: np.ndarray, signal: np.ndarray, clearance: np.ndarray) -> dict[str, np.ndarray]:
    """(order, missed, held) of each bar from the votes' delta, the wanted position and the one before it, the entry signal and
    the sum of the clearances to MA90 and MA120. A buy opens at once, at height by steps; a sell cuts by steps, at height or
    after a deep fall all at once; without a signal the position follows the target, and a cut beyond what is held is passive.
    A rise that meets no position is missed, from there on. A target that neither moves nor stands still leaves no value."""
    n = len(delta)
    order, missed, held = np.zeros(n), np.zeros(n, np.int64), np.full(n, np.nan)
    have, lost = 0.0, 0
    for i in range(n):
        move, high = before[i] - norm[i], clearance[i] > HIGH
        want, after = 0.0, have if abs(move) < STILL else np.nan
        if move > 0:
            if signal[i] > 0:
                want = abs(max(move, delta[i])) if high else abs(norm[i])
                after = want
            elif have > 0:
                want, after = move, have + move
            else:
                lost, after = 1, have
        elif move < 0:
            at_once = high or move < GIVE_UP if signal[i] < 0 else not have + move > 0
            want, after = (-max(before[i], have), 0.0) if at_once else (move, have + move)
        order[i], missed[i], held[i], have = want, lost, after, after
    return {"order": order, "missed": missed, "held": held}


def performance(df: DataFrame, ret: str, n: int = 252, risk_free: float = 0.02) -> DataFrame:
    """Adds annual (compound over n bars), sharpe (rolling) and drawdown (from the running peak of the compounded curve)."""
    df = df.withColumn("__l", F.log1p(F.coalesce(F.col(ret), F.lit(0.0))))
    df = df.withColumns({"annual": W.full(F.exp(F.sum("__l").over(W.frame(n))) - 1, n), "__curve": F.sum("__l").over(W.upto())})
    mean, sd = F.avg(ret).over(W.frame(n)), F.stddev_samp(ret).over(W.frame(n))
    sharpe = W.full((mean - risk_free / 252) / F.nullif(sd, F.lit(0.0)) * (252**0.5), n)
    peak = F.greatest(F.max("__curve").over(W.upto()), F.lit(0.0))
    return df.withColumns({"sharpe": sharpe, "drawdown": F.exp(F.col("__curve") - peak) - 1}).drop("__l", "__curve")


def max_drawdown(df: DataFrame, ret: str) -> DataFrame:
    curve = performance(df, ret)
    return curve.groupBy("symbol").agg(F.min("drawdown").alias("max_drawdown"))
