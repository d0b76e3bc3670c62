"""Bars and ticks from the tables at hand, and plain readers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .written import written


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bars_from_prints(lines: DataFrame, key: Column, order: list[str], named: Callable[[DataFrame], DataFrame] = lambda lines: lines) -> DataFrame:
    """OHLCV bars from ``ts, price, size`` and the ``symbol`` that ``named`` adds, written once; ``order`` is a total order of the prints of a bar.

    ``key`` is a number or time that rises with ``order`` and that few prints of a bar
    share. A bar's first and last keys are found with its sums, in buffers of fixed width:
    no print is sorted. Only the prints that have such a key are then ordered in full.
    """
    lines = lines.withColumn("_key", key)
    ends = named(lines).groupBy("symbol", "ts").agg(
        F.max("price").alias("high"), F.min("price").alias("low"), F.sum("size").alias("volume"), F.min("_key").alias("_first"), F.max("_key").alias("_last"),
    )
    ends = written(ends, "bar-ends")
    keys = ends.select(F.col("symbol").alias("_symbol"), F.col("ts").alias("_ts"), F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_end"))
    at_end = F.col("ts").eqNullSafe(F.col("_ts")) & F.col("_key").eqNullSafe(F.col("_end"))
    few = named(lines.join(keys, at_end, "left_semi")).join(keys, at_end & F.col("symbol").eqNullSafe(F.col("_symbol")), "left_semi")
    by = F.struct(*order)
    outer = few.groupBy(F.col("symbol").alias("_symbol"), F.col("ts").alias("_ts")).agg(F.min_by("price", by).alias("open"), F.max_by("price", by).alias("close"))
    bars = ends.join(outer, F.col("symbol").eqNullSafe(F.col("_symbol")) & F.col("ts").eqNullSafe(F.col("_ts")))
    return written(bars.select("symbol", "ts", "open", "high", "low", "close", "volume"), "bars")


def _micros(at: Column) -> Column:
    """Microseconds of a time without a zone, in any session's zone."""
    minutes = (F.unix_date(F.to_date(at)).cast("long") * 24 + F.hour(at)) * 60 + F.minute(at)
    return minutes * 60_000_000 + (F.date_part(F.lit("second"), at) * 1_000_000).cast("long")


def daily_bars(spark: SparkSession, folder: str) -> DataFrame:
    """A bar for each order priority and ship date; the adjusted close halves before 1998."""
    # The hint: prints meet orders by a shuffle without sorts, at every size.
    orders = read(spark, folder, "orders").select("o_orderkey", F.col("o_orderpriority").alias("symbol")).hint("shuffle_hash")
    items = read(spark, folder, "lineitem").withColumns({"ts": F.to_date("l_shipdate"), "price": F.col("l_extendedprice") / F.col("l_quantity"), "size": F.col("l_quantity")})
    bars = bars_from_prints(
        items, F.col("l_orderkey"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], lambda lines: lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    )
    ratio = F.when(F.col("ts") < F.lit("1998-01-01").cast("date"), 0.5).otherwise(1.0)
    return bars.withColumn("adjusted_close", F.col("close") * ratio)


def weekly_bars(spark: SparkSession, folder: str) -> DataFrame:
    """A bar for each brand and week of shipping."""
    parts = read(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("symbol")).hint("shuffle_hash")
    items = read(spark, folder, "lineitem").withColumns(
        {"ts": F.to_date(F.date_trunc("week", "l_shipdate")), "price": F.col("l_extendedprice") / F.col("l_quantity"), "size": F.col("l_quantity")}
    )
    # Time of shipping and order in one number; more than the range of an order's key lies between two times.
    key = _micros(F.col("l_shipdate")).cast("decimal(18,0)") * F.lit(str(2 * 10**19)).cast("decimal(20,0)") + F.col("l_orderkey").cast("decimal(19,0)")
    bars = bars_from_prints(
        items, key.cast("decimal(38,0)"), ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], lambda lines: lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    )
    return bars.withColumn("adjusted_close", F.col("close"))


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Trades ``symbol, ts, price, size`` from the event stream."""
    events = read(spark, folder, "events")
    return events.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("int").alias("size"), "event_id")


def resample(trades: DataFrame, unit: str = "hour") -> DataFrame:
    """Ticks to bars of a calendar unit; prints of one instant are ordered by their id."""
    return bars_from_prints(trades.withColumns({"at": F.col("ts"), "ts": F.date_trunc(unit, "ts").cast("timestamp_ntz")}), F.col("at"), ["at", "event_id"])


def hourly_bars(spark: SparkSession, folder: str) -> DataFrame:
    bars = resample(ticks(spark, folder)).withColumn("adjusted_close", F.col("close"))
    return bars.withColumn("session", F.to_date("ts"))


def read_bars(bars: DataFrame, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of some symbols and dates; the filters reach the scan."""
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(symbols))
    if start is not None:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.where(F.col("ts") <= F.lit(end).cast("date"))
    return bars


def adjust_bars(bars: DataFrame) -> DataFrame:
    """Open, high, low and close on the basis of the adjusted close."""
    ratio = F.when(F.col("close") == 0, F.lit(1.0)).otherwise(F.col("adjusted_close") / F.col("close"))
    return bars.withColumns({c: F.col(c) * ratio for c in ("open", "high", "low")} | {"close": F.col("adjusted_close")})


def read_intraday(spark: SparkSession, paths: list[str], zone: str = "UTC") -> DataFrame:
    """Bars from many files: instants in UTC, numbers as doubles, one row for each symbol and instant, the one with the most volume."""
    rows = spark.read.option("mergeSchema", "true").parquet(*paths)
    number = {c: F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")}
    rows = rows.select(F.upper("symbol").alias("symbol"), F.to_utc_timestamp("ts", zone).alias("ts"), *number.values()).where("ts is not null and close is not null")
    best = F.max(F.struct("volume", "close", "open", "high", "low")).alias("b")
    return rows.groupBy("symbol", "ts").agg(best).select("symbol", "ts", *[F.col(f"b.{c}").alias(c) for c in number])
