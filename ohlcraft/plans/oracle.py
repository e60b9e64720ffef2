"""SQL pieces that the checking queries share."""

from __future__ import annotations

#: Daily bars, as sources.bars.day_bars.
BARS = """bars AS (
  SELECT symbol, dt, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close,
         sum(q) AS volume, sum(a) AS amount
  FROM (SELECT l_suppkey AS symbol, l_shipdate AS dt, l_extendedprice / l_quantity AS px, l_quantity AS q, l_extendedprice AS a,
               l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey AS k FROM lineitem)
  GROUP BY symbol, dt),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS rn FROM bars)"""

#: Ticks, as sources.bars.ticks.
TICKS = "ticks AS (SELECT event_type AS symbol, ts AS dt, value AS price, 1 AS vol FROM events)"


def over(n: int) -> str:
    """Frame of the last n rows of a symbol."""
    return f"OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


W = "OVER (PARTITION BY symbol ORDER BY dt)"
UPTO = "OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
P = "OVER (PARTITION BY symbol)"


def full(expr: str, n: int) -> str:
    return f"CASE WHEN rn >= {n} THEN {expr} END"


def sma(c: str, n: int) -> str:
    return full(f"avg({c}) {over(n)}", n)


def since(event: str) -> str:
    """Bars since an event."""
    return f"rn - coalesce(last_value(CASE WHEN {event} THEN rn END IGNORE NULLS) {UPTO}, 0)"


def run(flag: str) -> str:
    """Length of the current run of a flag."""
    return since(f"NOT coalesce({flag}, false)")


def with_bars(body: str) -> str:
    return f"WITH {BARS}{body}"
