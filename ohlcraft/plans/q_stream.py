"""Queries of tick streams, quote rows, repairs, exports and codes that had none."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions import window as W
from ..operators import indicators as I
from ..operators import kernels as K
from ..sources import bars as B
from ..sources.bars import day_bars
from ..streaming import bars as streaming
from .oracle import UPTO, P, since, with_bars
from .oracle import W as OW
from .q_more import _detector
from .q_window import R, numbered, r

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local one where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='ohlcraft-')}"
    return f"{base.rstrip('/')}/bars-{uuid.uuid4().hex}"


def _tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = B.table(spark, sf_dir, "events")
    raw = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/events.parquet*")
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("dt"), F.col("value").alias("price"), F.lit(1).alias("vol"))


_PEAKS = _detector("pa", 10, 3).replace("JOIN b ON b.", "JOIN t b ON b.").replace("FROM b WHERE", "FROM t WHERE")


@query(f"WITH RECURSIVE t AS (SELECT event_type AS symbol, ts AS dt, value AS close, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM events){_PEAKS} SELECT pa.symbol, pa.dt, t.close AS price, pa.sig::INT AS signal FROM pa JOIN t ON t.symbol = pa.symbol AND t.rn = pa.rn")
def stream_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peak detector over the event stream, one value at a time, its state held between micro batches."""
    folder = _folder(spark)
    found = streaming.stream_peaks(_tick_stream(spark, sf_dir))
    q = found.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/peaks").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/peaks").select("symbol", F.col("dt").cast("timestamp_ntz").alias("dt"), "price", "signal")


@query("""WITH q AS (SELECT event_type || '.X' AS code, date_trunc('second', ts) AS datetime, value AS price, event_id % 3 AS vol, date_trunc('day', ts) AS d FROM events)
SELECT code, datetime, price, vol::DOUBLE AS vol FROM q QUALIFY row_number() OVER (PARTITION BY code, datetime ORDER BY price) = 1""")
def upserted_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw quotes as ticks, sent twice in two micro batches into the upserting sink of a folder for each day, and read back."""
    folder = _folder(spark)
    ev = B.table(spark, sf_dir, "events")
    raw = ev.select(
        F.col("event_type").alias("code"), F.lit("X").alias("exchange"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH:mm:ss").alias("time"), F.col("value").cast("string").alias("now"),
        (F.col("event_id") % 3).cast("string").alias("volume"),
    )
    ticks = streaming.formatted_quotes(raw)
    write = streaming.upsert_sink(f"{folder}/ticks", ["code", "datetime"], "datetime")
    write(ticks.withColumn("price", F.lit(0.0)), 0)
    write(ticks, 1)
    return streaming.read_upserted(spark, f"{folder}/ticks").select("code", F.col("datetime").cast("timestamp_ntz").alias("datetime"), "price", "vol")


@query("""WITH a AS (SELECT event_type AS symbol, time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE AS dt, time_bucket(INTERVAL 30 MINUTE, ts) AS w, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events GROUP BY ALL)
SELECT symbol, w + INTERVAL 30 MINUTE AS dt, arg_min(open, dt) AS open, max(high) AS high, min(low) AS low, arg_max(close, dt) AS close, sum(volume)::BIGINT AS volume FROM a GROUP BY symbol, w""")
def bars_of_bars_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour bars out of ten-minute bars, by a window over the finer window."""
    t = B.ticks(spark, sf_dir).withColumn("dt", F.col("dt").cast("timestamp"))
    out = streaming.coarser(streaming.stream_bars(t, "10 minutes"), "30 minutes")
    return out.select("symbol", F.col("dt").cast("timestamp_ntz").alias("dt"), "open", "high", "low", "close", F.col("volume").cast("bigint").alias("volume"))


@query("SELECT event_id, value AS price, CASE WHEN event_id % 7 = 0 THEN value ELSE value * 0.5::DOUBLE END AS open, CASE WHEN event_id % 11 = 0 THEN value ELSE value * 0.25::DOUBLE END AS low FROM events WHERE value > 0")
def repaired_opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks whose open or low came as 0."""
    ev = B.table(spark, sf_dir, "events").where("value > 0")
    raw = ev.select("event_id", F.col("value").alias("price"), F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(F.col("value") * 0.5).alias("open"), F.when(F.col("event_id") % 11 == 0, 0.0).otherwise(F.col("value") * 0.25).alias("low"))
    return streaming.repaired(raw)


_MINUTE = "hour(ts) * 60 + minute(ts)"


@query(f"SELECT event_id, ts, ts::DATE AS day FROM events WHERE ({_MINUTE} >= 0 AND {_MINUTE} <= 690 AND {_MINUTE} >= 570) OR ({_MINUTE} >= 780 AND {_MINUTE} <= 900)")
def trading_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the trading hours, with the day whose collection they go to."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    ev = B.table(spark, sf_dir, "events").where(minute.between(570, 690) | minute.between(780, 900))
    return ev.select("event_id", "ts", F.to_date("ts").alias("day"))


@query("SELECT symbol, dt FROM (SELECT event_type AS symbol, ts AS dt, floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts))) AS gap FROM events) WHERE gap IS NULL OR gap >= 300")
def throttled_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a symbol, five minutes apart at least."""
    return streaming.throttled(B.ticks(spark, sf_dir).select("symbol", "dt"), 300)


@query("SELECT event_id::BIGINT AS event_id, round(value, 4) AS value FROM events")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of CSV payloads: a text of each user with a header line."""
    ev = B.table(spark, sf_dir, "events").select("user_id", F.concat_ws(",", "event_id", F.round("value", 4)).alias("line"))
    texts = ev.groupBy("user_id").agg(F.concat(F.lit("event_id,value\n"), F.array_join(F.collect_list("line"), "\n")).alias("payload"))
    return B.rows_from_csv(texts, "payload", "event_id bigint, value double")


@query("""WITH t AS (SELECT event_type AS symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS dt, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close FROM events GROUP BY 1, 2)
SELECT symbol, dt, round(open, 2) + 0::DOUBLE AS open, round(high, 2) + 0::DOUBLE AS high, round(low, 2) + 0::DOUBLE AS low, round(close, 2) + 0::DOUBLE AS close FROM t WHERE strftime(dt, '%H:%M:%S') <> '09:30:00'""")
def without_opening_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = B.ticks(spark, sf_dir).withColumn("w", F.window(F.col("dt").cast("timestamp"), "15 minutes")["start"].cast("timestamp_ntz"))
    bars = t.groupBy("symbol", F.col("w").alias("dt")).agg(F.min_by("price", "dt").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "dt").alias("close"))
    return B.drop_opening_print(bars)


@query(with_bars(f" SELECT symbol, dt, {R('CASE WHEN rn >= 200 THEN close + 1 ELSE close END')} AS close FROM b"))
def merged_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two downloads that overlap by 100 bars; the later one's prices stay."""
    b = numbered(spark, sf_dir)
    first, second = b.where("rn < 300").select("symbol", "dt", "close"), b.where("rn >= 200").select("symbol", "dt", (F.col("close") + 1).alias("close"))
    return B.merge_downloads([first, second]).select("symbol", "dt", r(F.col("close")).alias("close"))


@query(with_bars(f" SELECT symbol, dt, {R('close')} AS close, CASE WHEN symbol % 2 = 0 THEN 'even' ELSE 'odd' END AS market FROM b"))
def exported_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written by market without the columns that exports leave out, and read back."""
    folder = _folder(spark)
    b = day_bars(spark, sf_dir).withColumns({"market": F.when(F.col("symbol") % 2 == 0, "even").otherwise("odd"), "date_stamp": F.lit(0), "up_count": F.lit(1)})
    B.export(b, f"{folder}/export")
    out = spark.read.parquet(f"{folder}/export")
    return out.select("symbol", "dt", r(F.col("close")).alias("close"), "market").where(F.lit("date_stamp" not in out.columns))


@query("SELECT code::BIGINT AS code, source FROM (SELECT s_suppkey AS code, 'balance' AS source FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT DISTINCT l_suppkey, 'tax' FROM lineitem WHERE l_tax > 0.07 UNION ALL SELECT s_suppkey, 'nation' FROM supplier WHERE s_nationkey < 5)")
def saved_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block members of three sources in one written table."""
    folder = _folder(spark)
    s, lines = B.table(spark, sf_dir, "supplier"), B.table(spark, sf_dir, "lineitem")
    parts = [s.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("code"), F.lit("balance").alias("source")), lines.where("l_tax > 0.07").select(F.col("l_suppkey").alias("code"), F.lit("tax").alias("source")).distinct(),
             s.where("s_nationkey < 5").select(F.col("s_suppkey").alias("code"), F.lit("nation").alias("source"))]
    parts[0].unionByName(parts[1]).unionByName(parts[2]).write.mode("overwrite").parquet(f"{folder}/blocks")
    return spark.read.parquet(f"{folder}/blocks")


@query(with_bars(f""", a AS (SELECT *, {since('close > open')} AS ja, {since('close < open')} AS sa, 100 * (close / lag(close) {OW} - 1) AS x FROM b), n AS (SELECT *, greatest(1, trunc(10 * least(median(ja) {P}, median(sa) {P})))::BIGINT AS n FROM a),
 l AS (SELECT *, list(abs(x)) FILTER (WHERE x IS NOT NULL) {UPTO} AS v FROM n) SELECT symbol, dt, n, {R('CASE WHEN len(v) >= n THEN list_median(v[-n:]) END')} AS spread FROM l"""))
def variable_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median size of the daily move over a window that comes from the symbol's own rhythm."""
    df = numbered(spark, sf_dir).withColumns({"ja": W.bars_since(F.col("close") > F.col("open")), "sa": W.bars_since(F.col("close") < F.col("open")), "x": 100 * W.pct_change("close")})
    n = F.greatest(F.lit(1), F.floor(10 * F.least(F.median("ja").over(W.whole()), F.median("sa").over(W.whole())))).cast("bigint")
    df = df.withColumn("n", n).select("symbol", "dt", "n", "x")
    found = I.with_kernel(df, ["x", "n"], "spread double", lambda x, n: {"spread": K.variable_median(x, int(n[0]))}, ["n"])
    return found.select("symbol", "dt", "n", r(F.col("spread")).alias("spread"))


_CODES = ("sz000001", "sh600519", "000001", "XSHG.600000", "600000.XSHG", "688001", "159919", "399001", "510300", "btcusdt", "IF2101", "what?")


@query("SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {known}, '{kind}', '{ex}')" for c, known, kind, ex in zip(_CODES, ("true",) * 11 + ("false",), ("stock", "stock", "stock", "stock", "stock", "stock", "fund", "index", "fund", "crypto", "future", "unknown"),
    ("XSHE", "XSHG", "XSHE", "XSHG", "XSHG", "XSHG", "XSHE", "XSHE", "XSHG", "crypto", "future", "unknown"))) + ") AS t(code, known, kind, exchange)")
def classified_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(c,) for c in _CODES], "code string")
    return df.withColumn("k", scalar.classify_code(F.col("code"))).select("code", "k.known", "k.kind", "k.exchange")
