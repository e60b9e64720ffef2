"""Bar and tick tables: derivation, scans, dedup, unions, upserts and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frequency aliases and the minutes of a bar.
FREQUENCIES = {"1min": 1, "1m": 1, "5min": 5, "5m": 5, "15min": 15, "15m": 15, "30min": 30, "30m": 30, "60min": 60, "60m": 60, "1h": 60}
SESSION_START, SESSION_END = "09:30:00", "15:00:00"
MIN_BARS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlcv(rows: DataFrame, keys: list[str], price: str, order: str, volume: str, amount: str | None = None) -> DataFrame:
    """Bars from trades or ticks: first, highest, lowest, last price and sums; partial aggregation before one shuffle."""
    aggs = [
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(volume).alias("volume"),
    ]
    if amount:
        aggs.append(F.sum(amount).alias("amount"))
    return rows.groupBy(*keys).agg(*aggs)


def day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the suppliers' sales: symbol, dt, open, high, low, close, volume, amount."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"),
        F.col("l_shipdate").alias("dt"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        (F.col("l_orderkey") * 1000000000 + F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("k"),
        "l_quantity",
        "l_extendedprice",
    )
    return ohlcv(li, ["symbol", "dt"], "px", "k", "l_quantity", "l_extendedprice")


def ticks(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    """Ticks of the event stream: symbol, dt, price, vol."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col(symbol).cast("string").alias("symbol"), F.col("ts").alias("dt"), F.col("value").alias("price"), F.lit(1).alias("vol"))


def scan(bars: DataFrame, symbols: list | None, start: str | None, end: str | None, time_of_day: bool = False) -> DataFrame:
    """Bars of a code list and date range; both filters reach the scan. Minute scans run from session start to end."""
    if start is not None and start == end:
        raise ValueError("start and end are the same")
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(symbols))
    if start is not None:
        bars = bars.where(F.col("dt") >= F.lit(f"{start} {SESSION_START}" if time_of_day else start).cast("timestamp_ntz"))
    if end is not None:
        bars = bars.where(F.col("dt") <= F.lit(f"{end} {SESSION_END}" if time_of_day else end).cast("timestamp_ntz"))
    return bars


def minutes_of(frequency: str) -> int:
    if frequency not in FREQUENCIES:
        raise ValueError(f"unknown frequency {frequency}")
    return FREQUENCIES[frequency]


def enough_bars(bars: DataFrame, least: int = MIN_BARS) -> DataFrame:
    """Symbols with fewer than least bars are dropped."""
    n = F.count("*").over(Window.partitionBy("symbol"))
    return bars.withColumn("__n", n).where(F.col("__n") >= least).drop("__n")


def latest_ticks(ticks: DataFrame, symbols: list, num: int) -> DataFrame:
    """The num newest ticks of each symbol, newest first."""
    w = Window.partitionBy("symbol").orderBy(F.col("dt").desc(), F.col("price"))
    return ticks.where(F.col("symbol").isin(symbols)).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= num)


def newest_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in order: a deterministic drop_duplicates."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def append_last_day(history: DataFrame, realtime: DataFrame) -> DataFrame:
    """History with realtime bars whose (symbol, dt) it doesn't hold."""
    return history.unionByName(realtime.join(history.select("symbol", "dt"), ["symbol", "dt"], "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new replaces the rows of old with its keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def repair(preferred: DataFrame, fallback: DataFrame, columns: list[str]) -> DataFrame:
    """Null values of preferred are filled from fallback."""
    f = fallback.select("symbol", "dt", *[F.col(c).alias(f"__{c}") for c in columns])
    joined = preferred.join(f, ["symbol", "dt"], "left")
    return joined.withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def drop_opening_print(bars: DataFrame) -> DataFrame:
    """Without the empty bars of 09:30:00; prices to cents."""
    kept = bars.where(F.date_format("dt", "HH:mm:ss") != "09:30:00")
    return kept.withColumns({c: F.round(c, 2) for c in ("open", "high", "low", "close")})


def merge_downloads(parts: list[DataFrame]) -> DataFrame:
    """Overlapping downloads as one series: the later part wins."""
    tagged = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    return newest_rows(out, ["symbol", "dt"], [F.col("__part").desc()]).drop("__part")


def export(bars: DataFrame, path: str, fmt: str = "parquet", drop: tuple[str, ...] = ("date_stamp", "up_count", "down_count")) -> None:
    """Partitioned by market and frequency where the table has them."""
    parts = [c for c in ("market", "freq") if c in bars.columns]
    w = bars.drop(*drop).write.mode("overwrite").partitionBy(*parts) if parts else bars.drop(*drop).write.mode("overwrite")
    (w.option("header", "true") if fmt == "csv" else w).format(fmt).save(path)


def rows_from_csv(texts: DataFrame, column: str, schema: str) -> DataFrame:
    """A column of CSV payloads with a header line -> typed rows."""
    lines = texts.select(F.posexplode(F.split(F.col(column), "\r?\n")).alias("i", "line")).where("i > 0 and trim(line) <> ''")
    return lines.select(F.from_csv("line", schema).alias("r")).select("r.*")


def table_cells(pages: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows of regular expression matches in page sources: the keys of pages and m."""
    return pages.withColumn("m", F.explode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1)))).drop(column)


def needs_realtime(last: Column, now: Column, minute: bool = False) -> Column:
    """Whether realtime bars are asked for after the last bar held: older than 10 hours once the day has opened (09:15),
    before that older than 40 hours (24 for minute bars)."""
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(last.cast("timestamp"))) / 3600
    opened = F.date_format(now, "HH:mm") > "09:15"
    return F.when(opened, age > 10).otherwise(age > (24 if minute else 40))
