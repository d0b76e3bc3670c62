"""Daily features of every bar, all without look-ahead; null until the frame is full."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import by_symbol, frame, full, lag

RETURNS = (1, 3, 5, 10, 20, 60)
AVERAGES = (20, 50, 200)


def log_return(n: int, price: str = "close") -> Column:
    before = lag(price, n)
    return F.when((before > 0) & (F.col(price) > 0), F.log(F.col(price) / before))


def roc(n: int) -> Column:
    return F.when(lag("close", n) != 0, F.col("close") / lag("close", n) - 1)


def sma(n: int, c: str = "close") -> Column:
    return full(n, F.avg(c), frame(n))


def returns(bars: DataFrame) -> DataFrame:
    """Log returns over several horizons and the 10-bar rate of change."""
    return bars.withColumns({f"return_{n}d": log_return(n) for n in RETURNS} | {"roc_10": roc(10)})


def trend(bars: DataFrame) -> DataFrame:
    """Moving averages: distance, side and the change of the distance over five bars."""
    out = bars.withColumns({f"sma_{n}": sma(n) for n in AVERAGES})
    out = out.withColumns({f"sma_distance_{n}": F.col("close") / F.col(f"sma_{n}") - 1 for n in AVERAGES} | {f"above_sma_{n}": (F.col("close") > F.col(f"sma_{n}")).cast("double") for n in AVERAGES})
    return out.withColumns({f"sma_distance_momentum_{n}": F.col(f"sma_distance_{n}") - lag(f"sma_distance_{n}", 5) for n in AVERAGES})


def rsi_simple(bars: DataFrame, n: int = 14) -> DataFrame:
    """RSI from simple means of the last ``n`` changes (100 without a loss), and its change over five bars."""
    out = bars.withColumn("_d", F.col("close") - lag("close"))
    gain, loss = F.avg(F.greatest("_d", F.lit(0.0))), F.avg(F.greatest(-F.col("_d"), F.lit(0.0)))
    ready = F.count("_d").over(frame(n)) == n
    g, z = gain.over(frame(n)), loss.over(frame(n))
    out = out.withColumn(f"rsi_{n}", F.when(ready, F.when(z == 0, 100.0).otherwise(100 - 100 / (1 + g / z))))
    return out.withColumn("rsi_momentum", F.col(f"rsi_{n}") - lag(f"rsi_{n}", 5)).drop("_d")


def volatility(bars: DataFrame) -> DataFrame:
    """Mean true range over 14 bars and annualised deviation of log returns over 20 and 60."""
    before = lag("close")
    out = bars.withColumns({"_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)), "_r": log_return(1)})
    out = out.withColumn("_tr", F.when(before.isNotNull(), F.col("_tr")))
    out = out.withColumn("atr_14", F.when(F.count("_tr").over(frame(14)) == 14, F.avg("_tr").over(frame(14))))
    for n in (20, 60):
        out = out.withColumn(f"realized_vol_{n}", F.when(F.count("_r").over(frame(n)) == n, F.stddev_samp("_r").over(frame(n)) * F.sqrt(F.lit(252.0))))
    return out.drop("_tr", "_r")


def volume(bars: DataFrame) -> DataFrame:
    """Volume against the previous 20 bars, mean turnover, and five bars against the five before."""
    earlier = full(5, F.avg("volume"), frame(5, -5))
    return bars.withColumns(
        {
            "volume_ratio_20": F.col("volume") / full(20, F.avg("volume"), frame(20, -1)),
            "dollar_volume_20": full(20, F.avg(F.col("close") * F.col("volume")), frame(20)),
            "volume_trend_5": full(5, F.avg("volume"), frame(5)) / earlier - 1,
        }
    )


def relative_strength(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Log return less the benchmark's over the same dates; the benchmark has ``ts, close``."""
    base = benchmark.select("ts", F.col("close").alias("_b"))
    out = bars.join(base, "ts")
    out = out.withColumns({f"rs_{n}": log_return(n) - log_return(n, "_b") for n in (20, 60, 120)})
    return out.withColumn("rs_momentum", F.col("rs_20") - lag("rs_20", 5)).drop("_b")


def weighted_mean(n: int, c: str) -> Column:
    """Linearly weighted mean, the latest bar with weight ``n``, from the frame's values in order."""
    values = F.collect_list(c).over(frame(n))
    total = F.aggregate(F.zip_with(values, F.sequence(F.lit(1), F.lit(n)), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return F.when((F.count(c).over(frame(n)) == n), total / (n * (n + 1) / 2))


def hull(bars: DataFrame, n: int = 87, name: str | None = None) -> DataFrame:
    """Hull average ``WMA(2 WMA(n/2) - WMA(n), sqrt n)``, the close's distance from it and its side."""
    name = name or f"hma_{n}"
    out = bars.withColumn("_h", 2 * weighted_mean(n // 2, "close") - weighted_mean(n, "close"))
    out = out.withColumn(name, weighted_mean(round(n**0.5), "_h")).drop("_h")
    return out.withColumns({f"{name}_distance": F.col("close") / F.col(name) - 1, f"{name}_above": (F.col("close") > F.col(name)).cast("double")})


def market_regime(benchmark: DataFrame) -> DataFrame:
    """Per date of the benchmark: side of two averages, 20-bar return, trend +1, 0 or -1."""
    out = benchmark.withColumns({"_50": sma(50), "_200": sma(200)})
    out = out.withColumns({"above_50": F.col("close") > F.col("_50"), "above_200": F.col("close") > F.col("_200"), "return_20d": log_return(20)})
    trend = F.when(F.col("above_50") & F.col("above_200"), 1).when(~F.col("above_50") & ~F.col("above_200"), -1).otherwise(0)
    return out.select("ts", F.col("above_50").cast("double").alias("above_50"), F.col("above_200").cast("double").alias("above_200"), "return_20d", trend.alias("trend"))


def market_bar(bars: DataFrame) -> DataFrame:
    """An equal-weight benchmark: the mean close over all symbols of a date."""
    return bars.groupBy("ts").agg(F.avg("close").alias("close")).withColumn("symbol", F.lit("market"))


def sector_strength(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Simple 5-, 20- and 60-bar returns less the benchmark's, rank by 20 bars per date, first and last three."""
    base = benchmark.select("ts", *[roc(n).alias(f"_b{n}") for n in (5, 20, 60)])
    out = bars.select("symbol", "ts", *[roc(n).alias(f"ret_{n}d") for n in (5, 20, 60)]).join(base, "ts")
    out = out.withColumns({f"rs_{n}d": F.col(f"ret_{n}d") - F.col(f"_b{n}") for n in (5, 20, 60)})
    order = Window.partitionBy("ts").orderBy(F.desc(F.coalesce("rs_20d", F.lit(-999.0))), "symbol")
    day = Window.partitionBy("ts")
    out = out.withColumns({"rank_20d": F.row_number().over(order), "_n": F.count(F.lit(1)).over(day)})
    out = out.withColumns({"leading": F.col("rank_20d") <= 3, "lagging": F.col("rank_20d") > F.col("_n") - 3})
    return out.select("symbol", "ts", *[f"rs_{n}d" for n in (5, 20, 60)], "rank_20d", "leading", "lagging")


def regime_interactions(df: DataFrame, features: list[str], masks: list[str]) -> DataFrame:
    """Products of features and 0/1 masks; a missing mask counts as 0."""
    return df.withColumns({f"{f}_x_{m}": F.col(f) * F.coalesce(F.col(m).cast("double"), F.lit(0.0)) for f in features for m in masks})


def build_features(bars: DataFrame, benchmark: DataFrame, least: int = 15) -> DataFrame:
    """All features above in one plan with one shuffle by symbol; null before a symbol has ``least`` bars."""
    steps = (returns, trend, rsi_simple, volatility, volume)
    out = relative_strength(reduce(lambda df, f: f(df), steps, bars), benchmark)
    names = [c for c in out.columns if c not in bars.columns]
    out = out.withColumn("bars_so_far", F.count(F.lit(1)).over(by_symbol()))
    return out.withColumns({c: F.when(F.col("bars_so_far") >= least, F.col(c)) for c in names})
