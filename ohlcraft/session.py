"""Session helper for scripts and tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "ohlcraft", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session in UTC; a cluster supplies its own session instead."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
