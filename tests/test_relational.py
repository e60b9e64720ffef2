"""Joins, unions, screens, codes, streaming and patterns on small fixtures."""

import datetime as d

import pytest
from pyspark.sql import functions as F

from ohlcraft.functions import scalar as S
from ohlcraft.operators import market, ml, patterns
from ohlcraft.operators import relational as R
from ohlcraft.sources import bars as B
from ohlcraft.streaming import bars as streaming


def t(day, h=0, m=0):
    return d.datetime(2024, 1, day, h, m)


def test_codes(spark):
    given = {
        "sz000001": ("000001.XSHE", "stock"), "sh600519": ("600519.XSHG", "stock"), "XSHG.600000": ("600000.XSHG", "stock"),
        "600000.XSHG": ("600000.XSHG", "stock"), "688001": ("688001.XSHG", "stock"), "159919": ("159919.XSHE", "fund"),
        "399001": ("399001.XSHE", "index"), "btcusdt": ("btcusdt", "crypto"), "IF2101": ("if2101", "future"), "?": ("?", "unknown"),
    }
    df = spark.createDataFrame([(k,) for k in given], "c string")
    got = {x.c: (x.n, x.k) for x in df.select("c", S.normalize_code(F.col("c")).alias("n"), S.classify_code(F.col("c"))["kind"].alias("k")).collect()}
    assert got == given
    priced = spark.createDataFrame([("000001", 3000.0), ("000001", 10.0)], "c string, p double").select(S.normalize_code(F.col("c"), F.col("p")).alias("n"))
    assert [x.n for x in priced.collect()] == ["000001.XSHG", "000001.XSHE"]


def test_split_codes(spark):
    df = spark.createDataFrame([("'a1'\nb2、c3，d4/ e5 \"a1\"",)], "s string")
    assert df.select(S.split_codes(F.col("s")).alias("x")).first().x == ["a1", "b2", "c3", "d4", "e5"]


def test_asof_upsert_repair_union(spark):
    left = spark.createDataFrame([(1, t(2), 1.0), (1, t(5), 2.0), (2, t(1), 3.0)], "symbol long, dt timestamp_ntz, x double")
    right = spark.createDataFrame([(1, t(2), 10.0), (1, t(4), 20.0)], "symbol long, dt timestamp_ntz, y double")
    assert {(x.symbol, x.x): x.y for x in R.asof(left, right, ["y"]).collect()} == {(1, 1.0): None, (1, 2.0): 20.0, (2, 3.0): None}
    new = spark.createDataFrame([(1, t(5), 9.0), (3, t(1), 8.0)], left.schema)
    assert sorted(x.x for x in B.upsert(left, new, ["symbol", "dt"]).collect()) == [1.0, 3.0, 8.0, 9.0]
    assert sorted(x.x for x in B.append_last_day(left, new).collect()) == [1.0, 2.0, 3.0, 8.0]
    holes = left.withColumn("x", F.when(F.col("x") > 1, F.col("x")))
    assert sorted(x.x for x in B.repair(holes, left, ["x"]).collect()) == [1.0, 2.0, 3.0]


def test_scan_and_screens(spark):
    bars = spark.createDataFrame([(1, t(1), 1.0), (1, t(3), None), (2, t(2), 3.0)], "symbol long, dt timestamp_ntz, close double")
    assert B.scan(bars, [1], "2024-01-01", "2024-01-02").count() == 1
    with pytest.raises(ValueError):
        B.scan(bars, None, "2024-01-01", "2024-01-01")
    with pytest.raises(ValueError):
        B.minutes_of("7min")
    hit, rest = R.screen(bars, "close > 2", "long")
    assert [x.tags for x in hit.collect()] == ["long,"] and rest.count() == 2
    cascade = R.last_match_wins([(1, F.col("close") > 0), (2, F.col("close") > 2)])
    assert sorted(x.c for x in bars.select(cascade.alias("c")).collect()) == [0, 1, 2]


def test_winsor_skip_rule(spark):
    small = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.1, 0.2, 0.1, 0.9])], "symbol long, dt long, x double")
    assert sorted(r.x for r in R.winsor_mad(small, "x").collect()) == [0.1, 0.1, 0.2, 0.9]
    big = spark.createDataFrame([(1, i, x) for i, x in enumerate([1.0, 2.0, 3.0, 2.0, 500.0])], "symbol long, dt long, x double")
    assert max(r.x for r in R.winsor_mad(big, "x").collect()) == pytest.approx(2 + 3 * 1.4826)


def test_download_merge_csv_and_exports(spark, tmp_path):
    a = spark.createDataFrame([(1, t(1), 1.0), (1, t(2), 2.0)], "symbol long, dt timestamp_ntz, x double")
    b = spark.createDataFrame([(1, t(2), 5.0), (1, t(3), 6.0)], a.schema)
    assert [x.x for x in B.merge_downloads([a, b]).orderBy("dt").collect()] == [1.0, 5.0, 6.0]
    text = spark.createDataFrame([("code,px\nA,1.5\nB,2\n",)], "body string")
    assert [(x.code, x.px) for x in B.rows_from_csv(text, "body", "code string, px double").collect()] == [("A", 1.5), ("B", 2.0)]
    for fmt in ("parquet", "csv"):
        B.export(a.withColumn("market", F.lit("cn")).withColumn("date_stamp", F.lit(1)), str(tmp_path / fmt), fmt)
        back = spark.read.option("header", "true").format(fmt).load(str(tmp_path / fmt))
        assert back.count() == 2 and "date_stamp" not in back.columns and "market" in back.columns


def test_stream_equals_batch_and_upsert(spark, tmp_path):
    rows = [("a", t(1, 10, m), float(m), 1) for m in range(50)] + [("b", t(1, 9, 30 + m), float(m), 2) for m in range(20)]
    df = spark.createDataFrame(rows, "symbol string, dt timestamp, price double, vol int")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    sink = streaming.upsert_sink(str(tmp_path / "out"), ["symbol", "dt"])
    bars = streaming.stream_bars(stream, "5 minutes").drop("window")
    q = bars.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(x.symbol, x.dt): (x.open, x.high, x.low, x.close, x.volume) for x in streaming.read_upserted(spark, str(tmp_path / "out")).collect()}
    batch = streaming.stream_bars(df, "5 minutes").collect()
    assert got == {(x.symbol, x.dt): (x.open, x.high, x.low, x.close, x.volume) for x in batch} and len(got) == 14
    sink(streaming.stream_bars(df, "5 minutes").drop("window"), 7)
    sink(streaming.stream_bars(df, "5 minutes").drop("window"), 7)
    assert streaming.read_upserted(spark, str(tmp_path / "out")).count() == 14


def test_chained_bars(spark):
    rows = [("a", t(1, 10, m), float(m), 1) for m in range(60)]
    df = spark.createDataFrame(rows, "symbol string, dt timestamp, price double, vol int")
    (bar,) = streaming.coarser(streaming.stream_bars(df, "5 minutes"), "60 minutes").collect()
    assert (bar.open, bar.high, bar.low, bar.close, bar.volume) == (0.0, 59.0, 0.0, 59.0, 60)


def test_streaming_peaks(spark, tmp_path):
    rows = [("a", t(1, 10, m), 10.0 + (m % 2) + (80 if m == 40 else 0), 1) for m in range(60)]
    df = spark.createDataFrame(rows, "symbol string, dt timestamp, price double, vol int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streaming.stream_peaks(stream).writeStream.outputMode("append").format("memory").queryName("peaks").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [x.dt.minute for x in spark.table("peaks").where("signal = 1").collect()] == [40]


def test_alerts_and_quotes(spark):
    df = spark.createDataFrame([("a", t(1, 1, 0)), ("a", t(1, 1, 4)), ("a", t(1, 1, 10)), ("b", t(1, 1, 0))], "symbol string, dt timestamp")
    assert streaming.throttled(df).count() == 3
    raw = spark.createDataFrame([("600000", "XSHG", "2024-01-01", "09:30:00", "1.5", "10")] * 2, "code string, exchange string, date string, time string, now string, volume string")
    (x,) = streaming.formatted_quotes(raw).collect()
    assert (x.code, x.price, x.vol) == ("600000.XSHG", 1.5, 10.0)


def test_breadth_counts_nulls_as_said(spark):
    f = spark.createDataFrame([(t(1), 1, None), (t(1), 0, 2.0), (t(1), None, -1.0)], "dt timestamp_ntz, BOOTSTRAP_I int, BOLL_RENKO double")
    (x,) = R.breadth(f).collect()
    assert (x.BOOTSTRAP_I, x.BOLL_RENKO, x.total) == (1, -1, 3)


def test_patterns_on_drawn_candles(spark):
    base = [(10.0, 11.0, 9.0, 10.5), (10.5, 11.5, 9.5, 10.0)] * 8
    rows = base + [(12.0, 12.1, 9.9, 10.0), (9.8, 12.6, 9.7, 12.5)]  # a long black bar swallowed by a white one
    df = spark.createDataFrame([(1, i, *x) for i, x in enumerate(rows)], "symbol long, dt long, open double, high double, low double, close double")
    last = patterns.patterns(df).orderBy(F.desc("dt")).first()
    assert last.p_engulfing == 100 and last.p_doji == 0 and last.p_longline == 100
    assert len(patterns.rules()) == 61


def test_circle(spark):
    import math

    pts = [("c", 3 + 2 * math.cos(a), -1 + 2 * math.sin(a)) for a in (0, 1, 2, 3, 4, 5)]
    x = ml.circle(spark.createDataFrame(pts, "k string, x double, y double"), "k", "x", "y").first()
    assert (x.cx, x.cy, x.radius) == pytest.approx((3, -1, 2))
