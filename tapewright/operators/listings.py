"""Performance after a listing, and studies of it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import by_symbol

#: Horizons in bars after a listing (fixed values).
HORIZONS = (1, 5, 10, 21, 42, 63, 90, 126, 180, 252)


def since_listing(listings: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars from the listing on with ``idx`` from 0, and the first bar's open and close."""
    rows = bars.join(listings.select("symbol", "listed"), "symbol").where(F.col("ts") >= F.col("listed"))
    rows = rows.withColumn("idx", F.row_number().over(by_symbol()) - 1)
    first = lambda c: F.max(F.when(F.col("idx") == 0, F.col(c))).over(Window.partitionBy("symbol"))
    return rows.withColumns({"open_0": first("open"), "close_0": first("close")})


def listing_performance(listings: DataFrame, bars: DataFrame, benchmark: DataFrame, horizons: Iterable[int] = HORIZONS) -> DataFrame:
    """Per listing: returns over horizons and less the benchmark's, worst fall and peak in a year, volume decay, deviations, the benchmark's regime, year-1 class."""
    horizons = list(horizons)
    rows = since_listing(listings, bars).join(benchmark.select("ts", F.col("close").alias("_b"), F.col("regime").alias("_regime")), "ts", "left").where("idx <= 252")
    w = Window.partitionBy("symbol").orderBy("idx")
    rows = rows.withColumns({"_top": F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_r": F.log(F.col("close") / F.lag("close").over(w))})
    at = lambda c, h: F.max(F.when(F.col("idx") == h, F.col(c)))
    change = lambda c, h: (at(c, h) / at(c, 0) - 1) * 100
    mean = lambda a, b: F.avg(F.when(F.col("idx").between(a, b), F.col("volume")))
    deviation = lambda n: F.when(F.count(F.when(F.col("idx") <= n, F.col("_r"))) >= 5, F.stddev_samp(F.when(F.col("idx") <= n, F.col("_r"))) * F.sqrt(F.lit(252.0)) * 100)
    out = rows.groupBy("symbol", "listed").agg(
        F.count(F.lit(1)).alias("bars"), *[change("close", h).alias(f"ret_{h}d") for h in horizons], *[(change("close", h) - change("_b", h)).alias(f"rel_{h}d") for h in horizons],
        F.min((F.col("close") / F.col("_top") - 1) * 100).alias("max_drawdown"), ((F.max("high") / F.max("open_0") - 1) * 100).alias("peak_pct"), F.max_by("idx", F.struct("high", -F.col("idx"))).alias("peak_idx"),
        (mean(16, 20) / mean(0, 4) - 1).alias("volume_decay"), deviation(30).alias("vol_30"), deviation(90).alias("vol_90"), F.min_by("_regime", "idx").alias("regime"),
        ((F.max("close_0") / F.max("open_0") - 1) * 100).alias("pop_pct"),
    )
    year = F.col("ret_252d")
    return out.withColumn("year1", F.when(year >= 50, "winner").when(year >= 0, "moderate").when(year >= -50, "loser").when(year.isNotNull(), "disaster"))


def listing_studies(performance: DataFrame, buckets: dict[str, Column], value: str, least: int = 3) -> DataFrame:
    """Mean, median and share above zero of a value by every bucket of every study, and over all."""
    pairs = F.array(F.struct(F.lit("overall").alias("study"), F.lit("all").alias("bucket")), *[F.struct(F.lit(n).alias("study"), c.cast("string").alias("bucket")) for n, c in buckets.items()])
    long = performance.where(F.col(value).isNotNull()).select(value, F.inline(pairs)).where("bucket is not null")
    out = long.groupBy("study", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), F.avg((F.col(value) > 0).cast("double")).alias("share_up"))
    return out.where(F.col("n") >= least)


def listing_breakdowns(performance: DataFrame, horizons: Iterable[int], keys: Iterable[str]) -> DataFrame:
    """The table of horizons: count, mean, median and win rate, over all and by each key."""
    later = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"ret_{h}d").alias("ret")) for h in horizons])
    pairs = F.array(F.struct(F.lit("all").alias("key"), F.lit("all").alias("value")), *[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])
    long = performance.select(F.inline(pairs), later.alias("_l")).where("value is not null").select("key", "value", F.inline("_l")).where("ret is not null")
    return long.groupBy("key", "value", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.percentile("ret", F.lit(0.5)).alias("median"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))


def window_returns(listings: DataFrame, bars: DataFrame, center: int, windows: Iterable[tuple[int, int]]) -> DataFrame:
    """Return over bar windows around ``center`` bars after a listing, and their mean volume against that of the first five bars."""
    rows = since_listing(listings, bars)
    week = rows.where("idx < 5").groupBy("symbol").agg(F.avg("volume").alias("_week"))
    spans = F.array(*[F.struct(F.lit(center + a).alias("first"), F.lit(center + b).alias("last")) for a, b in windows])
    met = rows.select("symbol", "idx", "close", "volume", F.inline(spans)).where("idx between first and last")
    out = met.groupBy("symbol", "first", "last").agg((F.max_by("close", "idx") / F.min_by("close", "idx") - 1).alias("_r"), F.avg("volume").alias("_v"), F.count(F.lit(1)).alias("bars"))
    return out.join(week, "symbol").select("symbol", "first", "last", "bars", (F.col("_r") * 100).alias("ret"), (F.col("_v") / F.col("_week")).alias("volume_ratio"))
