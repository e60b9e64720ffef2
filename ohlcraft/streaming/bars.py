"""Bars from tick streams: session buckets, watermarked aggregation, upserting sink, alerts, stateful peaks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import session_end


def bucketed(ticks: DataFrame, minutes: int) -> DataFrame:
    """Adds bucket: the end of the session bar a tick falls in, null outside of sessions."""
    day = F.date_trunc("day", "dt")
    end = session_end(F.hour("dt") * 60 + F.minute("dt"), minutes)
    at = day + F.make_dt_interval(F.lit(0), F.lit(0), end, F.lit(0))
    return ticks.withColumn("bucket", at.cast(ticks.schema["dt"].dataType))


def repaired(ticks: DataFrame) -> DataFrame:
    """Zero or negative open and low take the price."""
    fix = {c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.col("price")) for c in ("open", "low") if c in ticks.columns}
    return ticks.withColumns(fix) if fix else ticks


def stream_bars(ticks: DataFrame, width: str, late: str = "0 seconds") -> DataFrame:
    """Tumbling bars of a tick stream(symbol, dt timestamp, price, vol); ticks later than `late` are dropped."""
    w = F.window("dt", width)
    bars = ticks.withWatermark("dt", late).groupBy("symbol", w.alias("window")).agg(
        F.min_by("price", "dt").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "dt").alias("close"), F.sum("vol").alias("volume"),
    )
    return bars.select("symbol", F.col("window.end").alias("dt"), "open", "high", "low", "close", "volume", "window")


def coarser(bars: DataFrame, width: str) -> DataFrame:
    """Bars of bars, by a window over the finer window."""
    w = F.window("window", width)
    out = bars.groupBy("symbol", w.alias("w")).agg(
        F.min_by("open", "dt").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "dt").alias("close"), F.sum("volume").alias("volume"),
    )
    return out.select("symbol", F.col("w.end").alias("dt"), "open", "high", "low", "close", "volume")


def formatted_quotes(raw: DataFrame) -> DataFrame:
    """Raw quotes(code, exchange, date, time, now, volume) as ticks; the first of equal (code, datetime) stays."""
    out = raw.select(
        F.concat("code", F.lit("."), "exchange").alias("code"),
        F.to_timestamp(F.concat_ws(" ", "date", "time")).alias("datetime"),
        F.col("now").cast("double").alias("price"),
        F.col("volume").cast("double").alias("vol"),
    )
    if out.isStreaming:
        return out.withWatermark("datetime", "10 minutes").dropDuplicatesWithinWatermark(["code", "datetime"])
    w = Window.partitionBy("code", "datetime").orderBy("price")
    return out.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert_sink(path: str, keys: list[str], day: str = "dt") -> Callable[[DataFrame, int], None]:
    """foreachBatch function: rows of a micro batch replace those with their keys. Only the days of the batch are
    rewritten, each as a new version directory named by the batch, so a repeated batch writes the same again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("day", F.to_date(day).cast("string"))
        days = [x.day for x in new.select("day").distinct().collect()]  # days of one micro batch
        if not days:
            return
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        old: dict[str, list[int]] = {}
        for d in days:
            folder = jvm.org.apache.hadoop.fs.Path(f"{path}/day={d}")
            versions = sorted(int(x.getPath().getName()[2:]) for x in fs.listStatus(folder)) if fs.exists(folder) else []
            old[d] = [v for v in versions if v < batch_id]
        rows = new
        if any(old.values()):
            held = spark.read.option("basePath", path).parquet(*[f"{path}/day={d}/v={v[-1]}" for d, v in old.items() if v])
            held = held.drop("v").withColumn("day", F.col("day").cast("string"))
            rows = held.join(new.select("day", *keys), ["day", *keys], "left_anti").unionByName(new)
        out = rows.withColumn("v", F.lit(batch_id)).repartition("day")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "v").parquet(path)
        for d, versions in old.items():
            for v in versions[:-1]:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/day={d}/v={v}"), True)

    return write


def read_upserted(spark, path: str) -> DataFrame:
    """The newest version of each day."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    newest = []
    for d in fs.listStatus(at):
        if not d.getPath().getName().startswith("day="):
            continue
        versions = sorted(int(x.getPath().getName()[2:]) for x in fs.listStatus(d.getPath()))
        newest.append(f"{d.getPath()}/v={versions[-1]}")
    return spark.read.parquet(*newest)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Work off what is there, exactly once by the checkpoint."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def stale(latest: DataFrame, now: str, period_seconds: int, times: int = 3) -> DataFrame:
    """latest(symbol, dt) -> symbols whose last tick is older than `times` periods."""
    last = latest.groupBy("symbol").agg(F.max("dt").alias("dt"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("dt").cast("timestamp"))
    return last.withColumn("age", age).where(F.col("age") > times * period_seconds)


def throttled(alerts: DataFrame, seconds: int = 300) -> DataFrame:
    """alerts(symbol, dt): those that come `seconds` or more after the symbol's alert before."""
    before = F.lag("dt").over(Window.partitionBy("symbol").orderBy("dt"))
    gap = F.unix_timestamp(F.col("dt").cast("timestamp")) - F.unix_timestamp(before.cast("timestamp"))
    return alerts.withColumn("__gap", gap).where("__gap is null or __gap >= %d" % seconds).drop("__gap")


PEAK_STATE = "values array<double>, filtered array<double>"
PEAK_ROWS = "symbol string, dt timestamp, price double, signal int"


def peak_updates(lag: int, threshold: float, influence: float) -> Callable:
    """For applyInPandasWithState: the robust z-score peak detector, one value at a time. State is the last `lag`
    filtered values of a symbol."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        from ..operators.kernels import peak_step

        held = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(list(frames)).sort_values("dt", kind="stable").itertuples():  # frames of a micro batch come in any order
            signal, held = peak_step(held, float(r.price), lag, threshold, influence)
            out.append((key[0], r.dt, float(r.price), signal))
        state.update((held, held))
        yield pd.DataFrame(out, columns=["symbol", "dt", "price", "signal"])

    return update


def stream_peaks(ticks: DataFrame, lag: int = 10, threshold: float = 3.0, influence: float = 0.5) -> DataFrame:
    return ticks.groupBy("symbol").applyInPandasWithState(
        peak_updates(lag, threshold, influence), PEAK_ROWS, PEAK_STATE, "append", "NoTimeout"
    )


STRUCTURE_STATE = "dt array<timestamp>, high array<double>, low array<double>"
STRUCTURE_ROWS = "symbol string, dt timestamp, strokes int, mark string, price double"


def structure_updates(keep: int | None = None) -> Callable:
    """For applyInPandasWithState: strokes of each symbol after each micro batch. A bar that comes again replaces the one of
    its time; state is the symbol's high and low of all its bars (two numbers a bar), from which the structure is made anew.
    keep: only so many of the last bars, for streams that need the newest strokes and not their number."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        from ..operators.structure import fractals, merge_bars, strokes

        held: dict = {}
        if state.exists:
            held = {t: (h, x) for t, h, x in zip(*state.get)}
        for rows in frames:
            held |= {r.dt: (float(r.high), float(r.low)) for r in rows.itertuples()}
        times = sorted(held)[-keep:] if keep else sorted(held)
        high, low = [held[t][0] for t in times], [held[t][1] for t in times]
        state.update((times, high, low))
        import numpy as np

        bars = merge_bars(np.array(high), np.array(low))
        points = strokes(bars, fractals(bars))
        last = points[-1] if points else (None, None, None)
        yield pd.DataFrame({"symbol": [key[0]], "dt": [times[-1]], "strokes": [len(points)], "mark": [last[1]], "price": [last[2]]})

    return update


def stream_structure(bars: DataFrame, keep: int | None = None) -> DataFrame:
    return bars.groupBy("symbol").applyInPandasWithState(structure_updates(keep), STRUCTURE_ROWS, STRUCTURE_STATE, "update", "NoTimeout")
