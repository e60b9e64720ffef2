"""Shared folder, staged tables and Arrow batching for the text operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition: space and the six controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='ohlcraft-')}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local one where that is unset in local mode, as in tests. A cluster whose
    session names no shared folder is refused: its executors would not see each other's files."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own_folder()
    out = f"{base.rstrip('/')}/ohlcraft/{uuid.uuid4().hex}"
    atexit.register(_remove, spark, out)
    return out


def _remove(spark: SparkSession, folder: str) -> None:
    """At the driver's regular exit; staged tables must outlive the lazy frames that read them."""
    if spark.sparkContext._jsc is None or spark.sparkContext._gateway is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may have ended first; the folder is then the cluster's to expire
        return


def stage(df: DataFrame, folder: str, name: str, **options: str) -> DataFrame:
    """Write df below folder and read it back: lineage is cut and no executor holds the only copy."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(col: str = "text") -> Column:
    """Whole text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def utf8_of(col: str = "text") -> Column:
    return text_of(col).cast("binary")


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a block holds about limit bytes of column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = used = 0
        for i, n in enumerate(sizes):
            if used and used + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, used = i, 0
            used += n or 0
        yield batch.slice(start)


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], spread: Column, salts: int = 16) -> DataFrame:
    """Inner join on null-free keys that are unique in `one` and may be as frequent as a third of all rows in `many`: rows of
    `many` are dealt by keys and spread over `salts` parts, and each row of `one` goes to all of them."""
    dealt = many.withColumn("__salt", F.pmod(spread, F.lit(salts)).cast("int"))
    copies = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, "__salt"]).drop("__salt")
