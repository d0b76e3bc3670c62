"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Bars and ticks of :mod:`tapewright.sources.tables` in SQL.
PRINTS = """
    prints AS (
        SELECT o_orderpriority AS symbol, CAST(l_shipdate AS DATE) AS ts, l_extendedprice / l_quantity AS price, l_quantity AS size,
               l_orderkey, l_linenumber, l_partkey, l_suppkey
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
BARS = (
    PRINTS
    + """,
    raw_bars AS (
        SELECT symbol, ts, first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open, max(price) AS high, min(price) AS low,
               last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close, sum(size) AS volume
        FROM prints GROUP BY symbol, ts),
    daily AS (SELECT *, close * CASE WHEN ts < DATE '1998-01-01' THEN 0.5 ELSE 1.0 END AS adjusted_close FROM raw_bars),
    bars AS (
        SELECT symbol, ts, open * (adjusted_close / close) AS open, high * (adjusted_close / close) AS high, low * (adjusted_close / close) AS low,
               adjusted_close AS close, adjusted_close, volume
        FROM daily)"""
)
WEEKLY = """
    weekly AS (
        SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS ts,
               first(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open,
               max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
               last(l_extendedprice / l_quantity ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close,
               sum(l_quantity) AS volume
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
TICKS = """
    ticks AS (
        SELECT event_type AS symbol, ts, value AS price, CAST(json_extract_string(props, '$.k') AS INTEGER) AS size, event_id FROM events)"""
HOURLY = (
    TICKS
    + """,
    hourly AS (
        SELECT symbol, date_trunc('hour', ts) AS ts, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
               last(price ORDER BY ts, event_id) AS close, sum(size) AS volume, CAST(date_trunc('hour', ticks.ts) AS DATE) AS session
        FROM ticks GROUP BY symbol, date_trunc('hour', ticks.ts))"""
)
#: A symbol's bars in order.
W = "PARTITION BY symbol ORDER BY ts"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def s_frame(n: int, end: int = 0) -> str:
    low, high = end - n + 1, end
    side = lambda k: f"{-k} PRECEDING" if k < 0 else "CURRENT ROW" if k == 0 else f"{k} FOLLOWING"
    return f"({W} ROWS BETWEEN {side(low)} AND {side(high)})"


def s_full(n: int, value: str, end: int = 0) -> str:
    """A window value that needs its whole frame."""
    return f"CASE WHEN count(*) OVER {s_frame(n, end)} = {n} THEN {value} OVER {s_frame(n, end)} END"


def s_lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER ({W})"


def s_lead(c: str, n: int = 1) -> str:
    return f"lead({c}, {n}) OVER ({W})"


def s_round(c: str, digits: int = 6) -> str:
    return f"round(CAST({c} AS DOUBLE), {digits}) + 0.0"
