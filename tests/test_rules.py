"""Rule catalogues, transport of columns through kernels, covariance and learning kernels against plain loops."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohlcraft.functions import window as W
from ohlcraft.operators import backtest, ml, relational, rules
from ohlcraft.operators import indicators as I
from ohlcraft.plans.catalog import QUERIES


def test_kernels_keep_other_columns(spark):
    rows = [(1, "2024-01-02", 2.0, "b", None, 2**60 + 1), (1, "2024-01-01", 1.0, None, 7, 2**60 + 3), (2, "2024-01-01", None, "c", 1, 5)]
    df = spark.createDataFrame(rows, "symbol long, dt string, close double, name string, n int, big long")
    out = I.with_kernel(df, ["close"], "twice double, n bigint", lambda c: {"twice": 2 * c, "n": np.arange(len(c))})
    got = sorted(map(tuple, out.select("symbol", "dt", "close", "name", "big", "twice", "n").collect()), key=str)
    assert got == [(1, "2024-01-01", 1.0, None, 2**60 + 3, 2.0, 0), (1, "2024-01-02", 2.0, "b", 2**60 + 1, 4.0, 1), (2, "2024-01-01", None, "c", 5, None, 0)]


def test_cascade_looks_back_at_each_step(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(-2, 3, 60), rng.integers(-2, 3, 60)
    found = [rules.Rule(1, "x > 0 and prev <= 0"), rules.Rule(-1, "y < 0 and prev > 0"), rules.Rule(2, "x = 0", True), rules.Rule(-2, "prev = 2 and y <> 0", True)]
    want = np.zeros(60, int)
    for r in found:
        before = np.concatenate(([0], want[:-1]))
        hit = np.array([eval(r.predicate.replace(" = ", " == ").replace("<>", "!="), {"x": a, "y": b, "prev": p}) for a, b, p in zip(x, y, before)])
        want = np.where(hit & (~np.array([r.open] * 60) | (want == 0)), r.value, want)
    df = spark.createDataFrame([(1, i, int(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "symbol long, dt long, x long, y long")
    got = rules.cascade(W.numbered(df), found, F.lit(0), "v").orderBy("dt").collect()
    assert [r.v for r in got] == want.tolist()


def test_predicates_look_back_by_name():
    assert rules.lags_of(["a@1 < b and c@3 > a@1"]) == [("a", 1), ("c", 3)] and rules.plain("a@1 < b and {spike}") == "a__1 < b and spike"
    assert [k for k, _ in rules.STRENGTH_BUY] == [*range(1, 8), *range(10, 20), 8, 9] and [k for k, _ in rules.STRENGTH_SELL] == [-k for k in range(1, 8)]
    assert len(rules.MACD_TREND) == 21 and len(rules.BAND_SELL) == 11 and len(rules.BAND_BUY) == 3


def test_order_positions():
    a = lambda *x: np.array(x, float)
    out = backtest.order_positions(a(0.1, 0, 0, 0, 0, 0), a(0.2, 0.2, 0.3, 0.9, 0.1, 0.1), a(0.5, 0.2, 0.2, 0.2, 0.4, 0.3), a(1, 0, 0, -1, 0, 0), a(0, 0, 0, 0, 0, 0))
    assert out["order"].tolist() == pytest.approx([0.2, 0, -0.1, -0.2, 0, 0]) and out["held"].tolist() == pytest.approx([0.2, 0.2, 0.1, 0, 0, 0]) and out["missed"].tolist() == [0, 0, 0, 0, 1, 1]


def test_covariance_equals_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(f"2024-01-{d:02d} 00:00:00", s, float(rng.normal())) for d in range(1, 25) for s in "abcd" if rng.random() < 0.7] + [("2024-02-01 00:00:00", "e", 1.0)]
    df = spark.createDataFrame(rows, "dt string, symbol string, ret double").withColumn("dt", F.col("dt").cast("timestamp_ntz"))
    got = {(r.a, r.b): (r.cov, r.n) for r in relational.covariance(df).collect()}
    by = {s: {d: x for d, t, x in rows if t == s} for s in "abcde"}
    for a, b in itertools.combinations_with_replacement("abcde", 2):
        both = sorted(by[a].keys() & by[b].keys())
        if not both:
            assert (a, b) not in got
            continue
        cov, n = got[a, b]
        want = np.cov([by[a][d] for d in both], [by[b][d] for d in both])[0, 1] if len(both) > 1 else None
        assert n == len(both) and (cov is None if want is None else cov == pytest.approx(want))
    assert relational.covariance(df.limit(0)).count() == 0


def test_covariance_takes_any_number_of_symbols(spark):
    rng = np.random.default_rng(9)
    there, x = rng.random((9, 2300)) < 0.6, rng.normal(size=(9, 2300))
    rows = [(f"2024-01-{d + 1:02d} 00:00:00", s, float(x[d, s])) for d in range(9) for s in range(2300) if there[d, s]]
    df = spark.createDataFrame(rows, "dt string, symbol long, ret double").withColumn("dt", F.col("dt").cast("timestamp_ntz"))
    got = relational.covariance(df.repartition(3)).toPandas()
    n = there.T.astype(int) @ there.astype(int)
    assert len(got) == np.count_nonzero(np.triu(n)) and len(got.drop_duplicates(["a", "b"])) == len(got)
    assert (got.a <= got.b).all() and (got.n == n[got.a, got.b]).all() and (got["cov"].isna() == (got.n < 2)).all()
    for r in got.sample(300, random_state=1).itertuples():
        both = there[:, r.a] & there[:, r.b]
        assert r.n < 2 or r.cov == pytest.approx(np.cov(x[both, r.a], x[both, r.b])[0, 1])


def test_covariance_copies_no_returns_for_the_pairs(spark):
    rng = np.random.default_rng(31)
    rows = [(s, d, float(x)) for s in range(40) for d, x in enumerate(rng.normal(size=30)) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "symbol int, d int, ret double").selectExpr("symbol", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, d) as dt", "ret")
    got, small = (relational.covariance(df, tile) for tile in (1000, 3))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan  # the groups are read where they are
    got, small = ({(r.a, r.b): (r.cov, r.n) for r in x.collect()} for x in (got, small))
    assert len(got) == 820 and got.keys() == small.keys() and all(got[k] == (pytest.approx(small[k][0]), small[k][1]) for k in got)


def test_covariance_of_many_batches(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(40, 6))
    rows = [(f"2024-{d // 20 + 1:02d}-{d % 20 + 1:02d} 00:00:00", s, float(x[d, s])) for d in range(40) for s in range(6)]
    df = spark.createDataFrame(rows, "dt string, symbol int, ret double").withColumn("dt", F.col("dt").cast("timestamp_ntz"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {(r.a, r.b): (r.cov, r.n) for r in relational.covariance(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = np.cov(x.T)
    assert got == {(a, b): (pytest.approx(want[a, b]), 40) for a in range(6) for b in range(a, 6)}


def test_longest_chain_by_all_subsets():
    rng = np.random.default_rng(6)
    for _ in range(40):
        v = rng.integers(0, 8, rng.integers(1, 10)).astype(float)
        longest = max(k for k in range(len(v) + 1) if any(all(x < y for x, y in zip(c, c[1:])) for c in itertools.combinations(v.tolist(), k)))
        found = ml.increasing(v)
        assert len(found) == longest and all(v[i] < v[j] and i < j for i, j in zip(found, found[1:]))


def test_model_tree_splits_where_the_error_is_least():
    rng = np.random.default_rng(7)
    y = np.concatenate([np.arange(30) * 0.5, 15 - np.arange(40) * 0.3]) + rng.normal(0, 0.05, 70)

    def error(i, j):
        x = np.arange(i, j)
        return float(np.sum((y[i:j] - np.polyval(np.polyfit(x, y[i:j], 1), x)) ** 2))

    best = min(range(10, 61), key=lambda k: error(0, k) + error(k, 70))
    assert best in {i for i, _ in ml.model_tree(y)} and ml.model_tree(y)[0][0] == 0 and ml.model_tree(y)[-1][1] == 70


def test_modes_add_up():
    y = np.sin(np.arange(200) / 4) + np.sin(np.arange(200) / 23) + np.arange(200) / 100
    assert np.allclose(ml.emd(y).sum(axis=0), y) and np.allclose(ml.eemd(y, trials=3).sum(axis=0), y)


def _dense_spline(x, y, n):
    """Natural cubic spline through (x, y) at 0..n-1 by a whole matrix."""
    h, k = np.diff(x), len(x)
    a, b = np.eye(k), np.zeros(k)
    for i in range(1, k - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    m, t = np.linalg.solve(a, b), np.arange(n)
    j = np.clip(np.searchsorted(x, t, side="right") - 1, 0, k - 2)
    d, e = x[j + 1] - t, t - x[j]
    return (m[j] * d**3 + m[j + 1] * e**3) / (6 * h[j]) + (y[j] / h[j] - m[j] * h[j] / 6) * d + (y[j + 1] / h[j] - m[j + 1] * h[j] / 6) * e


def test_modes_of_many_series_by_dense_splines():
    rng = np.random.default_rng(11)
    series = [rng.normal(size=n).cumsum() for n in (200, 3, 41, 0, 7, 333, 25)] + [np.ones(30), np.full(20, np.nan), np.arange(1.0, 50)]
    for y, got in zip(series, ml.emd_many(series, 4)):
        rest, modes = y, []
        while len(modes) < 4 and len(y) > 2:
            h = rest
            for done in range(11):
                up = np.flatnonzero((h[1:-1] > h[:-2]) & (h[1:-1] >= h[2:])) + 1
                down = np.flatnonzero((h[1:-1] < h[:-2]) & (h[1:-1] <= h[2:])) + 1
                if done == 10 or len(up) < 2 or len(down) < 2:
                    break
                hi, lo = (np.concatenate(([0], x, [len(y) - 1])) for x in (up, down))
                h = h - (_dense_spline(hi, h[hi], len(y)) + _dense_spline(lo, h[lo], len(y))) / 2
            if done < 10:
                break
            modes.append(h)
            rest = rest - h
        assert len(got) == len(modes) + 1 and np.allclose(got, [*modes, rest], atol=1e-8, equal_nan=True)


def test_modes_take_time_in_proportion():
    began = time.process_time()
    modes = ml.emd(np.random.default_rng(12).normal(size=12000), 1)
    assert len(modes) == 2 and time.process_time() - began < 3


def test_turns_are_counted_where_modes_are_made(spark):
    rng = np.random.default_rng(13)
    rows = [(s, d, float(x)) for s, n in ((None, 70), ("a", 60), ("b", 10), ("c", 150)) for d, x in enumerate(rng.normal(size=n).cumsum())]
    df = spark.createDataFrame(rows, "symbol string, d int, close double").selectExpr("symbol", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, d) as dt", "close")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")  # a symbol's rows come in several batches
    try:
        got = {(r.symbol, r.mode): (r.turns, r.power) for r in ml.bar_mode_turns(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    modes = ml.modes_frame(df)
    want = {(r.symbol, r.mode): (r.turns, pytest.approx(r.power)) for r in ml.mode_turns(modes).collect()}
    assert got == want and len(got) == 16 and ml.best_modes(modes).count() == ml.best_turns(ml.bar_mode_turns(df)).count() > 4


def test_modes_take_fifty_trials_of_every_series(spark):
    y = {s: np.random.default_rng(s).normal(size=n).cumsum() for s, n in ((1, 12), (2, 700))}
    rows = [(s, d, float(x)) for s, v in y.items() for d, x in enumerate(v)]
    df = spark.createDataFrame(rows, "symbol int, d int, close double").selectExpr("symbol", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, d) as dt", "close")
    got = {(r.symbol, r.mode): (r.turns, r.power) for r in ml.bar_mode_turns(df, most=17).collect()}
    for s, v in y.items():
        modes = ml.eemd(v, trials=50, most=17)[:-1]
        assert [got[s, k + 1] for k in range(17)] == [(np.count_nonzero(np.diff(np.sign(m))), pytest.approx(np.std(m))) for m in modes]
    assert got[1, 1][0] > 0 and got[2, 6][0] > 0
    best = QUERIES["eemd_modes"](spark, "/root/testdata/sf0.001").toPandas()
    assert best["mode"].max() > 4 and (best.groupby("symbol").size() == 4).all()


def test_clusters_part_what_is_apart(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(c * 50 + rng.normal()), float(c * -50 + rng.normal())) for i, c in enumerate([0, 1] * 60)]
    got = ml.clusters(spark.createDataFrame(rows, "i long, x double, y double"), ["x", "y"], k=2).select("i", "cluster").collect()
    label = {r.i: r.cluster for r in got}
    assert label[0] != label[1] and all(label[i] == label[i % 2] for i in label)


def test_a_constant_density_does_not_cross_its_mean(spark):
    rows = [(k, i, x) for k in range(1, 97) for i, x in enumerate([k / 97 + 0.5] * 25 + [k / 97] * 60 + [k / 97 + 0.2])]
    df = W.numbered(spark.createDataFrame(rows, "symbol int, dt int, density double"))
    got = I.combo_flow(df, ["density"])
    assert got.columns == ["symbol", "dt", "density", "rn", "combo", "combo_ma", "combo_slope", "combo_cross", "combo_run"]
    assert sorted((r.symbol, r.dt) for r in got.where("combo_cross = 1").collect()) == [(k, 85) for k in range(1, 97)]
