"""Queries of sources, predicates, joins, aggregations, sets, sorts and scalar functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import window as W
from ..operators import relational as R_
from ..sources import bars as B
from .oracle import P, TICKS, sma, with_bars
from .oracle import W as OW
from .q_window import R, numbered, r

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir).withColumn("ret", W.pct_change("close"))


RET = f", r AS (SELECT *, close / lag(close) {OW} - 1 AS ret FROM b)"


@query(with_bars(f" SELECT symbol, date_trunc('week', dt)::TIMESTAMP AS dt, {R('arg_min(open, dt)')} AS open, {R('max(high)')} AS high, {R('min(low)')} AS low, {R('arg_max(close, dt)')} AS close, {R('sum(volume)')} AS volume FROM b GROUP BY 1, 2"))
def bars_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.day_bars(spark, sf_dir).groupBy("symbol", F.date_trunc("week", "dt").cast("timestamp_ntz").alias("wk"))
    out = b.agg(F.min_by("open", "dt").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "dt").alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.col("wk").alias("dt"), *[r(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")])


@query(with_bars(f" SELECT symbol, dt, {R('close')} AS close FROM b WHERE symbol IN (1, 2, 3) AND dt BETWEEN '1996-01-01' AND '1996-12-31'"))
def scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = B.scan(B.day_bars(spark, sf_dir), [1, 2, 3], "1996-01-01", "1996-12-31")
    return li.select("symbol", "dt", r(F.col("close")).alias("close"))


@query(with_bars(" SELECT symbol, count(*)::BIGINT AS n FROM b GROUP BY symbol HAVING count(*) >= 500"))
def enough_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.enough_bars(B.day_bars(spark, sf_dir), 500).groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"WITH {TICKS} SELECT symbol, dt, price, rn::BIGINT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC, price) AS rn FROM ticks WHERE symbol IN ('click', 'view', 'purchase', 'signup', 'error')) WHERE rn <= 5")
def latest_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.latest_ticks(B.ticks(spark, sf_dir), ["click", "view", "purchase", "signup", "error"], 5)
    return found.select("symbol", "dt", "price", F.col("rn").cast("bigint").alias("rn"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.newest_rows(B.table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id")])
    return rows.select("user_id", "event_type", "event_id")


@query(with_bars(f", old AS (SELECT * FROM b WHERE dt < '2001-06-01'), new AS (SELECT symbol, dt, close * 1.01::DOUBLE AS close FROM b WHERE dt >= '2001-05-01') SELECT symbol, dt, {R('close')} AS close FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.symbol = o.symbol AND n.dt = o.dt) UNION ALL SELECT symbol, dt, {R('close')} FROM new"))
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.day_bars(spark, sf_dir).select("symbol", "dt", "close")
    new = b.where("dt >= '2001-05-01'").withColumn("close", F.col("close") * 1.01)
    return B.upsert(b.where("dt < '2001-06-01'"), new, ["symbol", "dt"]).select("symbol", "dt", r(F.col("close")).alias("close"))


@query(with_bars(f", old AS (SELECT * FROM b WHERE dt < '2001-06-01'), new AS (SELECT * FROM b WHERE dt >= '2001-05-25') SELECT symbol, dt, {R('close')} AS close FROM old UNION ALL SELECT symbol, dt, {R('close')} FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE n.symbol = o.symbol AND n.dt = o.dt)"))
def realtime_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.day_bars(spark, sf_dir)
    return B.append_last_day(b.where("dt < '2001-06-01'"), b.where("dt >= '2001-05-25'")).select("symbol", "dt", r(F.col("close")).alias("close"))


@query(with_bars(f", a AS (SELECT symbol, dt, CASE WHEN rn % 7 = 0 THEN NULL ELSE close END AS close, close AS raw FROM b) SELECT symbol, dt, {R('coalesce(close, raw)')} AS close FROM a"))
def null_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = numbered(spark, sf_dir).select("symbol", "dt", "close", "rn")
    holes = b.withColumn("close", F.when(F.col("rn") % 7 != 0, F.col("close"))).drop("rn")
    return B.repair(holes, b, ["close"]).select("symbol", "dt", r(F.col("close")).alias("close"))


@query(with_bars(f" SELECT dt, count(*)::BIGINT AS total, sum(CASE WHEN close > open THEN 1 ELSE 0 END)::BIGINT AS up, sum(CASE WHEN close >= open THEN 1 ELSE -1 END)::BIGINT AS vote, {R('avg(close)', 3)} AS mean, {R('sum(volume)')} AS volume FROM b GROUP BY dt"))
def market_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = B.day_bars(spark, sf_dir).select(
        "dt",
        (F.col("close") > F.col("open")).cast("int").alias("BOOTSTRAP_I"),
        F.when(F.col("close") >= F.col("open"), 1).otherwise(-1).alias("BOLL_RENKO"),
        F.col("close").alias("PEAK_OPEN"),
        F.col("volume").alias("FLU_POSITIVE"),
    )
    return R_.breadth(f).select("dt", "total", F.col("BOOTSTRAP_I").alias("up"), F.col("BOLL_RENKO").alias("vote"), r(F.col("PEAK_OPEN"), 3).alias("mean"), r(F.col("FLU_POSITIVE")).alias("volume"))


@query(with_bars(f", blocks AS (SELECT s_suppkey AS symbol, r_name AS block FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT dt, block, count(*)::BIGINT AS total, {R('sum(volume)')} AS volume FROM b JOIN blocks USING (symbol) GROUP BY dt, block"))
def block_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = B.day_bars(spark, sf_dir).join(blocks(spark, sf_dir), "symbol").withColumnRenamed("volume", "FLU_POSITIVE")
    return R_.breadth(f, ("dt", "block")).select("dt", "block", "total", r(F.col("FLU_POSITIVE")).alias("volume"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, block): membership of suppliers in regions; nation and region have 30 rows by definition."""
    s, n, g = (B.table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    j = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(g), n.n_regionkey == g.r_regionkey)
    return j.select(F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("block"))


@query(with_bars(" SELECT symbol, round_even(close / 100, 0) * 100 AS level, sum(volume) AS volume FROM b GROUP BY 1, 2"))
def price_by_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R_.price_by_volume(B.day_bars(spark, sf_dir), 100.0)


@query(with_bars(f" SELECT symbol, dt, {R(f'least(greatest(close, quantile_cont(close, 0.025) {P}), quantile_cont(close, 0.975) {P})')} AS close FROM b"))
def winsor_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R_.winsor_quantile(B.day_bars(spark, sf_dir), "close").select("symbol", "dt", r(F.col("close")).alias("close"))


@query(with_bars(f", m AS (SELECT symbol, dt, close, median(close) {P} AS m FROM b), d AS (SELECT *, 4.4478::DOUBLE * median(abs(close - m)) {P} AS d FROM m) SELECT symbol, dt, {R('least(greatest(close, m - d), m + d)')} AS close FROM d"))
def winsor_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R_.winsor_mad(B.day_bars(spark, sf_dir).select("symbol", "dt", "close"), "close").select("symbol", "dt", r(F.col("close")).alias("close"))


@query(with_bars(f" SELECT symbol, dt, {R(f'least(greatest(close, avg(close) {P} - 3 * stddev_samp(close) {P}), avg(close) {P} + 3 * stddev_samp(close) {P})')} AS close FROM b"))
def winsor_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R_.winsor_sigma(B.day_bars(spark, sf_dir), "close").select("symbol", "dt", r(F.col("close")).alias("close"))


@query(with_bars(f" SELECT symbol, dt, {R(f'(close - min(close) {P}) / (max(close) {P} - min(close) {P})')} AS s1, {R(f'(close - avg(close) {P}) / stddev_samp(close) {P}')} AS s2, {R(f'close / pow(10, ceil(log10(max(abs(close)) {P})))')} AS s3, {R(f'(volume - avg(volume) {P}) / stddev_pop(volume) {P}')} AS z FROM b"))
def standardize_123(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.day_bars(spark, sf_dir)
    for kind in (1, 2, 3):
        df = R_.standardized(df, "close", f"s{kind}", kind)
    df = R_.column_zscore(df, "volume", "z")
    return df.select("symbol", "dt", *[r(F.col(c)).alias(c) for c in ("s1", "s2", "s3", "z")])


@query(with_bars(RET + f""", a AS (SELECT symbol, dt, ret FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) AS age FROM r WHERE ret IS NOT NULL) WHERE age <= 252),
 k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ret, dt) - 1 AS k, count(*) {P} AS n FROM a)
 SELECT symbol, {R("-sum(CASE WHEN k < n * 0.02::DOUBLE THEN ret ELSE 0 END) / (max(n) * 0.02::DOUBLE)")} AS es, {R("stddev_samp(ret) * 0.02::DOUBLE * 100", 3)} AS var, max(n)::BIGINT AS n FROM k GROUP BY symbol"""))
def expected_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    es = R_.expected_shortfall(returns(spark, sf_dir))
    return es.select("symbol", r(F.col("es")).alias("es"), r(F.col("var"), 3).alias("var"), "n")


@query(with_bars(RET + f", u AS (SELECT symbol, dt, ret FROM r WHERE ret IS NOT NULL) SELECT a.symbol AS a, b.symbol AS b, {R('covar_samp(a.ret, b.ret)', 3)} AS cov, count(*)::BIGINT AS n FROM u a JOIN u b USING (dt) WHERE a.symbol <= b.symbol GROUP BY 1, 2"))
def cov_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = returns(spark, sf_dir).where("ret is not null").select("symbol", "dt", "ret")
    return R_.covariance(u).select("a", "b", r(F.col("cov"), 3).alias("cov"), "n")


@query(with_bars(f", wk AS (SELECT symbol, date_trunc('week', dt) AS wk, arg_max(close, dt) AS close_major FROM b GROUP BY 1, 2) SELECT b.symbol, b.dt, {R('close')} AS close, {R('close_major')} AS close_major FROM b ASOF LEFT JOIN wk ON b.symbol = wk.symbol AND b.dt > wk.wk"))
def asof_major_minor(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.day_bars(spark, sf_dir).select("symbol", "dt", "close")
    wk = b.groupBy("symbol", F.date_trunc("week", "dt").cast("timestamp_ntz").alias("wk")).agg(F.max_by("close", "dt").alias("close_major"))
    out = R_.asof(b, wk.withColumnRenamed("wk", "dt"), ["close_major"])
    return out.select("symbol", "dt", r(F.col("close")).alias("close"), r(F.col("close_major")).alias("close_major"))


@query("SELECT s_suppkey, coalesce(n_name, s_nationkey::VARCHAR) AS name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON s_nationkey = n_nationkey")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("symbol"))
    n = B.table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("symbol"), F.col("n_name").alias("name"))
    return R_.named(s, n).select("s_suppkey", "name")


@query("SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49 AND l_discount > 0.09)")
def anti_join_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = B.table(spark, sf_dir, "lineitem").where("l_quantity > 49 and l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey"))
    return B.table(spark, sf_dir, "supplier").select("s_suppkey").join(li, "s_suppkey", "left_anti")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09)")
def semi_join_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = B.table(spark, sf_dir, "lineitem").where("l_quantity > 49 and l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey"))
    return B.table(spark, sf_dir, "supplier").select("s_suppkey").join(li, "s_suppkey", "left_semi")


@query("SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (1, 2) INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 EXCEPT SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 0")
def block_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = B.table(spark, sf_dir, "supplier"), B.table(spark, sf_dir, "nation").where("n_regionkey in (1, 2)")
    theme = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select("s_suppkey")  # nation has 25 rows
    quality = s.where("s_acctbal > 0").select("s_suppkey")
    return theme.intersect(quality).exceptAll(s.where("s_suppkey % 10 = 0").select("s_suppkey"))


@query("SELECT DISTINCT code FROM (SELECT s_suppkey AS code FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT l_suppkey FROM lineitem WHERE l_tax > 0.07)")
def union_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = B.table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("code"))
    b = B.table(spark, sf_dir, "lineitem").where("l_tax > 0.07").select(F.col("l_suppkey").alias("code"))
    return a.unionByName(b).distinct()


@query("WITH s AS (SELECT s_suppkey, n_name, r_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT s_suppkey AS symbol, 'all' AS universe FROM s UNION ALL SELECT s_suppkey, 'region:' || r_name FROM s UNION ALL SELECT s_suppkey, 'nation:' || n_name FROM s UNION ALL SELECT s_suppkey, 'quality' FROM s WHERE s_acctbal > 0")
def named_universes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, g = (B.table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    j = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(g), n.n_regionkey == g.r_regionkey)
    names = F.array_compact(F.array(F.lit("all"), F.concat(F.lit("region:"), "r_name"), F.concat(F.lit("nation:"), "n_name"), F.when(F.col("s_acctbal") > 0, "quality")))
    return j.select(F.col("s_suppkey").alias("symbol"), F.explode(names).alias("universe"))


@query(with_bars(f", u AS (SELECT symbol, dt, close FROM b), g AS (SELECT s.symbol, d.dt, u.close FROM (SELECT DISTINCT symbol FROM u) s CROSS JOIN (SELECT DISTINCT dt FROM u) d LEFT JOIN u USING (symbol, dt)) SELECT symbol, dt, {R('coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS close FROM g"))
def densify_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = B.day_bars(spark, sf_dir).select("symbol", "dt", "close")
    return R_.densified(u, ["close"]).select("symbol", "dt", r(F.col("close")).alias("close"))


@query(with_bars(f", f AS (SELECT *, close / lag(close) {OW} - 1 AS ret, {sma('close', 20)} AS ma FROM b) SELECT symbol, dt, CASE WHEN ret < -0.5 AND close < ma THEN 'weakshort,' WHEN ret > 2 AND close > ma THEN 'buylong,' END AS tags FROM f WHERE (ret < -0.5 AND close < ma) OR (ret > 2 AND close > ma)"))
def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = returns(spark, sf_dir).withColumn("ma", W.sma("close", 20))
    weak, rest = R_.screen(f, "(ret < -0.5) and (close < ma)", "weakshort")
    long, _ = R_.screen(rest, "(ret > 2) and (close > ma)", "buylong")
    return weak.unionByName(long).select("symbol", "dt", "tags")


@query(with_bars(f", f AS (SELECT *, close / lag(close) {OW} - 1 AS ret FROM b) SELECT symbol, dt, (CASE WHEN volume > 80 THEN 3 WHEN ret < -0.5 THEN 2 WHEN ret > 0 THEN 1 ELSE 0 END)::BIGINT AS code FROM f"))
def overwrite_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = returns(spark, sf_dir)
    code = R_.last_match_wins([(1, F.col("ret") > 0), (2, F.col("ret") < -0.5), (3, F.col("volume") > 80)])
    return f.select("symbol", "dt", code.cast("bigint").alias("code"))


@query("WITH c AS (SELECT DISTINCT l_shipdate AS dt FROM lineitem) SELECT dt, coalesce((month(dt) <> month(lead(dt) OVER (ORDER BY dt)))::BIGINT, 0) AS is_month_end FROM c")
def calendar_month_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R_.month_end(B.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("dt")).distinct())


@query("WITH c AS (SELECT DISTINCT l_shipdate AS dt FROM lineitem WHERE dayofweek(l_shipdate) NOT IN (0, 6)), d AS (SELECT DISTINCT o_orderdate AS day FROM orders) SELECT day, max(dt) AS dt FROM d JOIN c ON dt <= day AND dt >= day - INTERVAL 10 DAY GROUP BY day")
def walk_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = B.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("dt")).distinct().where("dayofweek(dt) not in (1, 7)")
    return R_.walk_back(cal, B.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("day")).distinct())


@query("""WITH c AS (SELECT p_partkey, lpad((p_partkey * 37 % 1000000)::VARCHAR, 6, '0') AS d, CASE p_partkey % 5 WHEN 0 THEN 'sz' WHEN 1 THEN 'sh' ELSE '' END AS pre, CASE p_partkey % 5 WHEN 2 THEN '.XSHE' WHEN 3 THEN '.XSHG' ELSE '' END AS suf, p_retailprice AS px FROM part)
 SELECT p_partkey, d || '.' || CASE WHEN pre = 'sh' OR suf = '.XSHG' THEN 'XSHG' WHEN pre = 'sz' OR suf = '.XSHE' THEN 'XSHE' WHEN d LIKE '000%' AND px > 2000 THEN 'XSHG'
   WHEN d[1:3] IN ('399','150','159','160','161','162','163','164','165','166','167','168','169','000','001','002','003','200','300','301') THEN 'XSHE' ELSE 'XSHG' END AS code,
   CASE WHEN d[1:3] = '399' THEN 'index' WHEN d[1:3] IN ('150','159','160','161','162','163','164','165','166','167','168','169','501','510','511','512','513','515','516','518','588') THEN 'fund'
   WHEN d[1:3] IN ('600','601','603','605','688','689','900','000','001','002','003','200','300','301') THEN 'stock' ELSE 'unknown' END AS kind FROM c""")
def normalize_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.table(spark, sf_dir, "part")
    d, k = F.lpad((F.col("p_partkey") * 37 % 1000000).cast("string"), 6, "0"), F.col("p_partkey") % 5
    raw = F.concat(F.when(k == 0, "sz").when(k == 1, "sh").otherwise(""), d, F.when(k == 2, ".XSHE").when(k == 3, ".XSHG").otherwise(""))
    return p.select("p_partkey", S.normalize_code(raw, F.col("p_retailprice")).alias("code"), S.classify_code(raw)["kind"].alias("kind"))


@query(r"SELECT p_partkey, unnest(list_distinct(list_filter(regexp_split_to_array(p_name || '/' || p_type || ', ' || p_brand || ' ' || p_brand, '[\n\r/\s、，,]+'), lambda x: x <> ''))) AS code FROM part")
def split_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit("/"), "p_type", F.lit(", "), "p_brand", F.lit(" "), "p_brand")
    return B.table(spark, sf_dir, "part").select("p_partkey", F.explode(S.split_codes(text)).alias("code"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<li><a[^>]*>([^<]*)</a>', 1)) AS m FROM pages""")
def html_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table_cells(B.table(spark, sf_dir, "pages").select("page_id", "html"), "html", "<li><a[^>]*>([^<]*)</a>")


@query("""WITH m AS (SELECT event_id, ts, hour(ts) * 60 + minute(ts) AS m FROM events),
 e AS (SELECT unnest(range(1, 1440)) AS x), g AS (SELECT x FROM e WHERE x % 60 = 0 AND (x > 570 AND x <= 690 OR x > 780 AND x <= 900))
 SELECT * FROM (SELECT event_id, CASE WHEN m IN (690, 900) THEN m ELSE (SELECT min(x) FROM g WHERE x > m) END::BIGINT AS bucket FROM m) WHERE bucket IS NOT NULL""")
def session_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.hour("ts") * 60 + F.minute("ts")
    return B.table(spark, sf_dir, "events").select("event_id", S.session_end(m, 60).cast("bigint").alias("bucket")).where("bucket is not null")


@query(f"WITH {TICKS}, t AS (SELECT *, dt::DATE + INTERVAL (h) MINUTE AS bucket FROM (SELECT *, CASE WHEN m IN (690, 900) THEN m ELSE (SELECT min(x) FROM (SELECT unnest([600, 630, 660, 690, 810, 840, 870, 900]) AS x) WHERE x > m) END AS h FROM (SELECT *, hour(dt) * 60 + minute(dt) AS m FROM ticks)) WHERE h IS NOT NULL) SELECT symbol, bucket::TIMESTAMP AS dt, arg_min(price, dt) AS open, max(price) AS high, min(price) AS low, arg_max(price, dt) AS close, count(*)::BIGINT AS volume FROM t GROUP BY 1, 2")
def resample_30min(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.bars import bucketed

    t = bucketed(B.ticks(spark, sf_dir), 30).where("bucket is not null")
    out = B.ohlcv(t, ["symbol", "bucket"], "price", "dt", "vol")
    return out.select("symbol", F.col("bucket").alias("dt"), "open", "high", "low", "close", F.col("volume").cast("bigint").alias("volume"))


@query(with_bars(f", x AS (SELECT *, lag(close > open) {OW} AS pos, close / lag(close) {OW} - 1 AS ret FROM b), g AS (SELECT *, sum(CASE WHEN coalesce(pos, false) THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY dt) AS g FROM x) SELECT symbol, dt, {R('CASE WHEN pos THEN sum(CASE WHEN pos THEN ret ELSE 0 END) OVER (PARTITION BY symbol, g ORDER BY dt) ELSE 0 END', 4)} AS held FROM g"))
def onhold_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.backtest import onhold_returns as held

    df = returns(spark, sf_dir).withColumn("position", (F.col("close") > F.col("open")).cast("int"))
    return held(df, "ret", "position", "held").select("symbol", "dt", r(F.col("held")).alias("held"))


@query(with_bars(f", x AS (SELECT *, close > open AS pos FROM b), e AS (SELECT *, CASE WHEN pos AND NOT coalesce(lag(pos) {OW}, false) THEN close END AS entry FROM x) SELECT symbol, dt, {R('CASE WHEN pos THEN close / last_value(entry IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 END')} AS held FROM e"))
def onhold_price_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.backtest import onhold_price_return as held

    df = numbered(spark, sf_dir).withColumn("position", (F.col("close") > F.col("open")).cast("int"))
    return held(df, "position", "held").select("symbol", "dt", r(F.col("held")).alias("held"))


@query(with_bars(RET + f", d AS (SELECT dt, count(*)::BIGINT AS n, avg((ret > 0)::INT) AS share, median(ret) AS m FROM r WHERE ret IS NOT NULL GROUP BY dt) SELECT dt, n, {R('share')} AS share, {R('m')} AS med, (CASE WHEN share > 0.1236 THEN 1 WHEN share > 0.0927 THEN 2 ELSE 0 END)::BIGINT AS state FROM d"))
def mass_uprising(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.market import mass_uprising as mass

    return mass(returns(spark, sf_dir).withColumn("lag_one", (F.col("ret") > 0).cast("int")), "lag_one", ["ret"]).select(
        "dt", "n", r(F.col("share")).alias("share"), r(F.col("ret")).alias("med"), F.col("state").cast("bigint").alias("state")
    )


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, '{\"event_id\":' || event_id || ',\"value\":' || value || '}' AS doc FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = B.table(spark, sf_dir, "events")
    return ev.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.to_json(F.struct("event_id", "value")).alias("doc"))


@query(with_bars(f" SELECT symbol, dt, printf('%.2f/%.2f%%', close + 1e-6::DOUBLE, 100 * (close / open - 1) + 1e-6::DOUBLE) AS text FROM b"))
def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.day_bars(spark, sf_dir)
    return b.select("symbol", "dt", S.display(F.col("close") + 1e-6, F.col("close") / F.col("open") - 1 + 1e-8).alias("text"))


@query(with_bars(f" SELECT symbol, strftime(dt, '%Y-%m-%d') AS date, epoch(dt)::BIGINT AS date_stamp, 'day' AS type, rn::BIGINT AS rn FROM b WHERE rn > 150"))
def store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the feature store: warm-up cut, date text and epoch seconds."""
    df = numbered(spark, sf_dir).where("rn > 150")
    return df.select("symbol", F.date_format("dt", "yyyy-MM-dd").alias("date"), F.unix_timestamp(F.col("dt").cast("timestamp")).alias("date_stamp"), F.lit("day").alias("type"), "rn")


@query(with_bars(f" SELECT symbol, {R('max(close)')} AS top, {R('(arg_max(close, dt) - max(close)) / max(close)')} AS drawdown, {R('avg(abs(close / open - 1))')} AS mean_move, count(*)::BIGINT AS n FROM b GROUP BY symbol"))
def symbol_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = B.day_bars(spark, sf_dir).groupBy("symbol")
    top = F.max("close")
    return g.agg(r(top).alias("top"), r((F.max_by("close", "dt") - top) / top).alias("drawdown"), r(F.avg(F.abs(F.col("close") / F.col("open") - 1))).alias("mean_move"), F.count("*").alias("n"))


@query(with_bars(f", a AS (SELECT symbol, dt AS t1, lead(dt, 20) {OW} AS t2 FROM b), k AS (SELECT a.symbol, t1, t2, sum(volume) AS v, count(*) AS n FROM a JOIN b ON a.symbol = b.symbol AND b.dt > t1 AND b.dt < t2 GROUP BY 1, 2, 3) SELECT symbol, t1, t2, {R('v')} AS volume, n::BIGINT AS n FROM k"))
def range_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume strictly between two marks, from running sums instead of a range join."""
    from ..operators.structure import sums_between

    b = B.day_bars(spark, sf_dir)
    marks = b.select("symbol", F.col("dt").alias("t1"), F.lead("dt", 20).over(Window.partitionBy("symbol").orderBy("dt")).alias("t2")).where("t2 is not null")
    return sums_between(marks, b, "volume").select("symbol", "t1", "t2", r(F.col("volume")).alias("volume"), "n")


