"""Feature registry, conditions and the incremental structure."""

import datetime as d

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohlcraft.operators import features, structure
from ohlcraft.streaming import bars as streaming


def bars(spark, n=80):
    p = 100 + np.cumsum(np.random.default_rng(8).normal(0, 1, n))
    rows = [(1, d.datetime(2024, 1, 1) + d.timedelta(days=i), float(x), float(x + 1), float(x - 1), float(x + 0.3), 10.0) for i, x in enumerate(p)]
    return spark.createDataFrame(rows, "symbol long, dt timestamp_ntz, open double, high double, low double, close double, volume double")


def test_registry(spark):
    df = features.resolved(bars(spark), ["macd", "ma_system", "macd"])
    assert {"dif", "ma120", "close"} <= set(df.columns) and df.count() == 80
    with pytest.raises(ValueError):
        features.resolved(bars(spark), ["macd_cross"], streaming=True)
    with pytest.raises(ValueError):
        features.resolved(bars(spark).drop("high"), ["atr"])


def test_conditions(spark):
    names = (
        "negative_lower_before mapower30_low_before mapower_baseline atr_lb boll_lb ma120 ma90 mapower30_high_before mapower_hmapower120_lag deadpool_lag dea "
        "macd_peak_low poly9 boll_lb_hma5_lag hmapower120_major mapower30_major boll_delta drawdown_ratio_major drawdown_ratio mapower30"
    ).split()
    df = spark.range(10).select(F.lit(1).alias("symbol"), F.col("id").alias("dt"), *[(F.col("id") + k).cast("double").alias(c) for k, c in enumerate(names)])
    got = features.conditions(df).orderBy("dt").collect()
    assert not got[0].cond_08 and got[1].cond_08 and not got[7].cond_02 and got[8].cond_02 and got[3].ftr_01 == 3 * 3 + 17 + 18 + 15


def test_incremental_structure_equals_batch(spark, tmp_path):
    b = bars(spark, 120).select(F.lit("a").alias("symbol"), F.col("dt").cast("timestamp").alias("dt"), "high", "low")
    rows = b.orderBy("dt").collect()
    for k in range(0, 120, 40):
        spark.createDataFrame(rows[k : k + 40], b.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.stream_structure(stream).writeStream.outputMode("update").format("memory").queryName("structure").trigger(availableNow=True).start()
    q.awaitTermination()
    m = structure.merge_bars(np.array([x.high for x in rows]), np.array([x.low for x in rows]))
    last = spark.table("structure").orderBy(F.desc("dt"), F.desc("strokes")).first()
    assert last.strokes == len(structure.strokes(m, structure.fractals(m)))
