"""Window primitives against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from ohlcraft.functions import window as W
from ohlcraft.operators import backtest


def loop_since(flags):
    out, t = [], 0
    for x in flags:
        t = 0 if x else t + 1
        out.append(t)
    return out


def loop_run(flags):
    out, t = [], 0
    for x in flags:
        t = t + 1 if x else 0
        out.append(t)
    return out


random.seed(3)
CASES = [
    [],
    [1] * 7,
    [0] * 7,
    [1, 0, 0, 0],
    [0, 0, 0, 1],
    [1, 0] * 5,
    [None, 1, None, 0, 1, 1, None],
    [random.choice([0, 1, None]) for _ in range(60)],
]


@pytest.fixture(scope="module")
def flags(spark):
    rows = [(k, i, None if x is None else bool(x)) for k, case in enumerate(CASES) for i, x in enumerate(case)]
    return W.numbered(spark.createDataFrame(rows, "symbol long, dt long, flag boolean"))


def test_bars_since_and_run_length(flags):
    got = flags.withColumns({"s": W.bars_since(F.col("flag")), "r": W.run_length(F.col("flag"))}).orderBy("symbol", "dt").collect()
    for k, case in enumerate(CASES):
        own = [x for x in got if x.symbol == k]
        assert [x.s for x in own] == loop_since(case)
        assert [x.r for x in own] == loop_run(case)


def test_signed_run(spark):
    values = [1, 1, 0, -1, -1, -1, 1, None, -1]
    df = W.numbered(spark.createDataFrame([(1, i, x) for i, x in enumerate(values)], "symbol long, dt long, x int"))
    got = [x.r for x in df.withColumn("r", W.signed_run(F.col("x"))).orderBy("dt").collect()]
    assert got == [1, 2, 0, -1, -2, -3, 1, 0, -1]


def test_monotone_and_constant_prices(spark):
    up = [(1, i, float(i + 1)) for i in range(60)] + [(2, i, 5.0) for i in range(60)]
    df = W.numbered(spark.createDataFrame(up, "symbol long, dt long, close double"))
    df = W.wma(W.hma(W.zscore(df, "close", 20, "z"), "close", 9, "h"), "close", 5, "w")
    got = df.withColumns({"slope": W.ols_slope("close", 14), "rank": W.pct_rank("close", 21), "sma": W.sma("close", 5)}).orderBy("symbol", "dt").collect()
    one, two = got[:60], got[60:]
    assert [x.sma for x in one[:5]] == [None] * 4 + [3.0]
    assert one[30].slope == pytest.approx(1.0) and one[30].rank == 1.0
    assert one[40].h == pytest.approx(one[40].close, abs=1.0)
    assert two[30].z is None and two[30].slope == pytest.approx(0.0) and two[30].w == pytest.approx(5.0)


def test_held_returns(spark):
    position, close = [0, 1, 1, 0, 0, 1, 1, 1], [10.0, 11.0, 12.0, 11.0, 10.0, 10.0, 12.0, 9.0]
    rows = [(1, i, c, p) for i, (c, p) in enumerate(zip(close, position))]
    df = W.numbered(spark.createDataFrame(rows, "symbol long, dt long, close double, position int"))
    df = df.withColumn("ret", F.coalesce(W.pct_change("close"), F.lit(0.0)))
    df = backtest.onhold_price_return(backtest.onhold_returns(df, "ret", "position", "held"), "position", "since")
    total, expected = 0.0, []
    for i in range(len(close)):
        held = i > 0 and position[i - 1] > 0
        total = total + close[i] / close[i - 1] - 1 if held else 0.0
        expected.append(total)
    got = df.orderBy("dt").collect()
    assert [x.held for x in got] == pytest.approx(expected)
    assert [x.since for x in got][1:3] == pytest.approx([0.0, 12 / 11 - 1]) and got[3].since is None
