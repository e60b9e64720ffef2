"""All queries of the bar engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_chan, q_indicators, q_models, q_more, q_relational, q_rules, q_stream, q_window

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for part in (q_window, q_relational, q_indicators, q_models, q_chan, q_more, q_rules, q_stream):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
