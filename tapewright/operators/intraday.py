"""Sessions of intraday bars, order flow from trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _session() -> Window:
    return Window.partitionBy("symbol", "session").orderBy("ts")


def session_columns(bars: DataFrame, zone: str = "UTC") -> DataFrame:
    """Local date, minute of the day, number of the bar in its session, and time bucket."""
    local = F.from_utc_timestamp("ts", zone)
    out = bars.withColumns({"session": F.to_date(local), "minute": F.hour(local) * 60 + F.minute(local)})
    bucket = F.when(F.col("minute") < 360, "night").when(F.col("minute") < 720, "morning").when(F.col("minute") < 1080, "afternoon").otherwise("evening")
    return out.withColumns({"candle_number": F.row_number().over(_session()), "time_bucket": bucket})


def session_vwap(bars: DataFrame) -> DataFrame:
    """Cumulative typical-price VWAP of the session, distance from it, side and crosses; a billionth apart is no side."""
    run = _session().rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = bars.withColumns({"_pv": F.sum(typical * F.col("volume")).over(run), "_v": F.sum("volume").over(run)})
    out = out.withColumn("vwap", F.when(F.col("_v") > 0, F.col("_pv") / F.col("_v"))).drop("_pv", "_v")
    out = out.withColumns({"vwap_distance": F.col("close") / F.col("vwap") - 1, "above_vwap": F.round(F.col("close") - F.col("vwap"), 9) > 0})
    before = F.lag("above_vwap").over(Window.partitionBy("symbol").orderBy("ts"))
    return out.withColumns({"cross_up": F.coalesce(F.col("above_vwap") & ~before, F.lit(False)), "cross_down": F.coalesce(~F.col("above_vwap") & before, F.lit(False))})


def opening_range(bars: DataFrame, first: int = 6) -> DataFrame:
    """High and low of a session's first bars, null while they form, and the first break on each side."""
    number = F.row_number().over(_session())
    day = Window.partitionBy("symbol", "session")
    out = bars.withColumn("_k", number)
    out = out.withColumns({"or_high": F.when(F.col("_k") > first, F.max(F.when(F.col("_k") <= first, F.col("high"))).over(day)), "or_low": F.when(F.col("_k") > first, F.min(F.when(F.col("_k") <= first, F.col("low"))).over(day))})
    up, down = F.coalesce(F.col("close") > F.col("or_high"), F.lit(False)), F.coalesce(F.col("close") < F.col("or_low"), F.lit(False))
    run = _session().rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({"_u": up.cast("int"), "_d": down.cast("int")})
    return out.withColumns({"break_up": (F.col("_u") == 1) & (F.sum("_u").over(run) == 1), "break_down": (F.col("_d") == 1) & (F.sum("_d").over(run) == 1)}).drop("_k", "_u", "_d")


def session_gap(bars: DataFrame) -> DataFrame:
    """Per session the first open against the close of the session before, if that is within a week."""
    days = bars.groupBy("symbol", "session").agg(F.min_by("open", "ts").alias("_o"), F.max_by("close", "ts").alias("_c"))
    w = Window.partitionBy("symbol").orderBy("session")
    near = F.datediff("session", F.lag("session").over(w)) <= 7
    return days.select("symbol", "session", F.when(near, (F.col("_o") / F.lag("_c").over(w) - 1) * 100).alias("gap_pct"))


def tick_direction(trades: DataFrame) -> DataFrame:
    """+1 after an up-tick, -1 after a down-tick; an unchanged price carries the last direction."""
    w = Window.partitionBy("symbol").orderBy("ts", "event_id")
    step = F.signum(F.col("price") - F.lag("price").over(w)).cast("int")
    out = trades.withColumn("_s", F.when(step != 0, step))
    return out.withColumn("direction", F.coalesce(F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("_s")


def footprint(trades: DataFrame, unit: str = "hour", tick: float = 10.0) -> DataFrame:
    """Buy, sell, delta and count per bar and price bucket, from trades with a ``direction``."""
    size = F.col("size")
    rows = trades.withColumns({"bar": F.date_trunc(unit, "ts").cast("timestamp_ntz"), "bucket": F.floor(F.col("price") / tick) * tick})
    out = rows.groupBy("symbol", "bar", "bucket").agg(
        F.sum(F.when(F.col("direction") > 0, size).otherwise(0)).alias("buy"), F.sum(F.when(F.col("direction") < 0, size).otherwise(0)).alias("sell"), F.count(F.lit(1)).alias("n"),
    )
    return out.withColumn("delta", F.col("buy") - F.col("sell"))


def footprint_summary(cells: DataFrame) -> DataFrame:
    """Per bar: totals, buy share, point of control (most volume, then the lowest price), running delta of the day."""
    total = F.col("buy") + F.col("sell")
    bars = cells.groupBy("symbol", "bar").agg(
        F.sum("buy").alias("buy"), F.sum("sell").alias("sell"), F.sum("delta").alias("delta"), F.max_by("bucket", F.struct(total, -F.col("bucket"))).alias("poc"),
    )
    day = Window.partitionBy("symbol", F.to_date("bar")).orderBy("bar").rowsBetween(Window.unboundedPreceding, 0)
    both = F.col("buy") + F.col("sell")
    return bars.withColumns({"buy_pct": F.when(both > 0, 100.0 * F.col("buy") / both), "cum_delta": F.sum("delta").over(day)})


def bar_outcomes(bars: DataFrame, horizon: int = 6, atr: Column | None = None) -> DataFrame:
    """Return, best and worst excursion over the next bars of a long entry, and which of +-1 ATR is hit first."""
    w = Window.partitionBy("symbol").orderBy("ts")
    unit = atr if atr is not None else F.col("high") - F.col("low")
    path = F.collect_list(F.struct("high", "low")).over(w.rowsBetween(1, horizon))
    out = bars.withColumns({"_path": path, "_unit": unit, "_later": F.lead("close", horizon).over(w)})
    first = lambda rule: F.array_position(F.transform("_path", rule), True)
    hit = lambda x: x["high"] >= F.col("close") + F.col("_unit")
    stop = lambda x: x["low"] <= F.col("close") - F.col("_unit")
    out = out.withColumns({"_hit": F.nullif(first(hit), F.lit(0)), "_stop": F.nullif(first(stop), F.lit(0))})
    target = F.col("_hit").isNotNull() & (F.col("_stop").isNull() | (F.col("_hit") < F.col("_stop")))
    out = out.withColumns(
        {
            "ret": (F.col("_later") / F.col("close") - 1) * 100,
            "mfe": (F.array_max(F.transform("_path", lambda x: x["high"])) / F.col("close") - 1) * 100,
            "mae": (F.array_min(F.transform("_path", lambda x: x["low"])) / F.col("close") - 1) * 100,
            "target_hit": target,
            "stop_hit": F.col("_stop").isNotNull() & ~target,
            "bars_to_hit": F.when(target, F.col("_hit")).otherwise(F.col("_stop")).cast("int"),
        }
    )
    return out.where(F.size("_path") > 0).drop("_path", "_unit", "_later", "_hit", "_stop")
