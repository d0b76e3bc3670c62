"""Candlestick patterns of one, two and three bars, and their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import frame, full, lag, lead

#: Pattern names and what they point to (fixed values).
BIAS = {
    "doji": "neutral", "hammer": "bullish", "inverted_hammer": "bullish", "shooting_star": "bearish", "hanging_man": "bearish",
    "marubozu_bull": "bullish", "marubozu_bear": "bearish", "spinning_top": "neutral", "long_bull": "bullish", "long_bear": "bearish",
    "engulfing_bull": "bullish", "engulfing_bear": "bearish", "harami_bull": "bullish", "harami_bear": "bearish",
    "piercing_line": "bullish", "dark_cloud_cover": "bearish", "tweezer_bottom": "bullish", "tweezer_top": "bearish",
    "morning_star": "bullish", "evening_star": "bearish", "three_white_soldiers": "bullish", "three_black_crows": "bearish",
    "three_inside_up": "bullish", "three_inside_down": "bearish",
}


def _anatomy(bars: DataFrame) -> DataFrame:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rows = bars.withColumns({"_b": F.abs(c - o), "_r": h - low, "_u": h - F.greatest(o, c), "_l": F.least(o, c) - low, "_g": c > o, "_k": c < o})
    rows = rows.withColumn("_avg", full(14, F.avg("_r"), frame(14)))
    return rows.withColumns({f"{x}{n}": lag(x, n) for n in (1, 2) for x in ("_b", "_g", "_k", "_avg", "open", "close", "high", "low")})


def _rules() -> dict[str, Column]:
    c = F.col
    o, close, b, r, u, d, avg = (c(x) for x in ("open", "close", "_b", "_r", "_u", "_l", "_avg"))
    # A bar without a range has no shares of it.
    some, green, red, r = r > 0, c("_g"), c("_k"), F.nullif(r, F.lit(0.0))
    hammer = some & (b / r < 0.35) & (d / r > 0.60) & (u / r < 0.10)
    inverted = some & (b / r < 0.35) & (u / r > 0.60) & (d / r < 0.10)
    bare = some & (d / r < 0.02) & (u / r < 0.02)
    mid1, mid2 = (c("open1") + c("close1")) / 2, (c("open2") + c("close2")) / 2
    harami_bull = lambda n, m: c(f"_k{m}") & c(f"_g{n}") & (c(f"open{n}") > c(f"close{m}")) & (c(f"close{n}") < c(f"open{m}"))
    harami_bear = lambda n, m: c(f"_g{m}") & c(f"_k{n}") & (c(f"open{n}") < c(f"close{m}")) & (c(f"close{n}") > c(f"open{m}"))
    even = lambda x: F.abs(c(x) - c(f"{x}1")) / F.nullif(c(x), F.lit(0.0)) < 0.001
    large = lambda share: (c("_b2") > share * c("_avg2")) & (b > share * avg)
    star = large(0.6) & (c("_b1") < 0.3 * c("_avg1"))
    three = large(0.5) & (c("_b1") > 0.5 * c("_avg1"))
    return {
        "doji": some & (b / r < 0.1),
        "hammer": hammer,
        "inverted_hammer": inverted,
        "shooting_star": inverted & red,
        "hanging_man": hammer & red,
        "marubozu_bull": bare & green,
        "marubozu_bear": bare & red,
        "spinning_top": some & (b / r < 0.30) & (d / r > 0.25) & (u / r > 0.25),
        "long_bull": green & (b > 1.5 * avg),
        "long_bear": red & (b > 1.5 * avg),
        "engulfing_bull": c("_k1") & green & (o <= c("close1")) & (close >= c("open1")),
        "engulfing_bear": c("_g1") & red & (o >= c("close1")) & (close <= c("open1")),
        "harami_bull": harami_bull("", 1),
        "harami_bear": harami_bear("", 1),
        "piercing_line": c("_k1") & green & (o < c("close1")) & (close > mid1) & (close < c("open1")),
        "dark_cloud_cover": c("_g1") & red & (o > c("close1")) & (close < mid1) & (close > c("open1")),
        "tweezer_bottom": even("low"),
        "tweezer_top": even("high"),
        "morning_star": c("_k2") & star & green & (close > mid2),
        "evening_star": c("_g2") & star & red & (close < mid2),
        "three_white_soldiers": c("_g2") & c("_g1") & green & three & (c("open1") > c("open2")) & (c("close1") > c("close2")) & (o > c("open1")) & (close > c("close1")),
        "three_black_crows": c("_k2") & c("_k1") & red & three & (c("open1") < c("open2")) & (c("close1") < c("close2")) & (o < c("open1")) & (close < c("close1")),
        "three_inside_up": harami_bull(1, 2) & green & (close > c("close1")),
        "three_inside_down": harami_bear(1, 2) & red & (close < c("close1")),
    }


def candlestick_patterns(bars: DataFrame) -> DataFrame:
    """One boolean column for each of 24 patterns; false where earlier bars are missing."""
    rows = _anatomy(bars).withColumns({name: F.coalesce(rule, F.lit(False)) for name, rule in _rules().items()})
    return rows.select(*bars.columns, *BIAS)


def pattern_signals(bars: DataFrame) -> DataFrame:
    """Fired patterns in long form with bias and strength ``0.6 body/range + 0.4 min(volume ratio, 3)/3``."""
    ratio = F.col("volume") / full(20, F.avg("volume"), frame(20, -1))
    rows = candlestick_patterns(bars).withColumn("_v", F.coalesce(ratio, F.lit(1.0)))
    size = F.col("high") - F.col("low")
    strength = 0.6 * F.when(size > 0, F.abs(F.col("close") - F.col("open")) / size).otherwise(0.0) + 0.4 * F.least("_v", F.lit(3.0)) / 3
    items = F.array(*[F.struct(F.lit(n).alias("pattern"), F.lit(b).alias("bias"), F.col(n).alias("fired")) for n, b in BIAS.items()])
    return rows.select("symbol", "ts", strength.alias("strength"), F.inline(items)).where("fired").drop("fired")


def pattern_context(bars: DataFrame) -> DataFrame:
    """Regime of the last 20 returns, deviation, side of the mean and volume, all from earlier bars."""
    ret = F.col("close") / lag("close", 20) - 1
    mean = full(20, F.avg("close"), frame(20, -1))
    ratio = F.col("volume") / full(20, F.avg("volume"), frame(20, -1))
    return bars.withColumns(
        {
            "regime": F.when(ret > 0.05, "up").when(ret < -0.05, "down").when(ret.isNotNull(), "flat"),
            "above_mean": F.col("close") > mean,
            "volume_context": F.when(ratio >= 1.5, "high").when(ratio <= 0.5, "low").when(ratio.isNotNull(), "normal"),
        }
    )


def pattern_outcome_stats(bars: DataFrame, horizon: int = 5) -> DataFrame:
    """Per pattern: count, mean, deviation and hit rate of the return some bars later, first and last date."""
    later = bars.withColumn("_f", (lead("close", horizon) / F.col("close") - 1) * 100).select("symbol", "ts", "_f")
    rows = pattern_signals(bars).join(later, ["symbol", "ts"]).where("_f is not null")
    out = rows.groupBy("pattern", "bias").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_f").alias("mean"), F.stddev_samp("_f").alias("std"), F.avg((F.col("_f") > 0).cast("int")).alias("hit_rate"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    return out.withColumn("std", F.when(F.col("n") > 1, F.col("std")))


#: The patterns of the trend-aware set (fixed names).
TREND_AWARE = (
    "doji", "long_legged_doji", "hammer", "inverted_hammer", "shooting_star", "hanging_man", "marubozu", "spinning_top", "bullish_engulfing", "bearish_engulfing", "inside_bar", "outside_bar", "harami",
    "tweezer_top", "tweezer_bottom", "morning_star", "evening_star", "three_white_soldiers", "three_black_crows",
)


def trend_aware_patterns(bars: DataFrame) -> DataFrame:
    """Nineteen stricter patterns: reversals need a trend, two closes in a row the same way, and stars a mean body over 20 bars."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rows = bars.withColumns({"_b": F.abs(c - o), "_r": h - low, "_u": h - F.greatest(o, c), "_l": F.least(o, c) - low, "_g": c > o, "_k": c < o})
    rising, falling = (c > lag("close")) & (lag("close") > lag("close", 2)), (c < lag("close")) & (lag("close") < lag("close", 2))
    spread = F.nullif("_r", F.lit(0.0))
    rows = rows.withColumns(
        {
            "_up": F.coalesce(rising, F.lit(False)), "_down": F.coalesce(falling, F.lit(False)), "_bp": F.coalesce(F.col("_b") / spread, F.lit(0.0)), "_us": F.coalesce(F.col("_u") / spread, F.lit(0.0)),
            "_ls": F.coalesce(F.col("_l") / spread, F.lit(0.0)), "_place": F.coalesce((F.least(o, c) - low) / spread, F.lit(0.0)), "_avg": F.coalesce(full(20, F.avg("_r"), frame(20)), F.col("_r")), "_mean": F.avg("_b").over(frame(20, -1)),
        }
    )
    rows = rows.withColumns({f"{x}{n}": lag(x, n) for n in (1, 2) for x in ("_b", "_g", "_k", "_up", "_down", "open", "close", "high", "low")})
    x = F.col
    b, u, d = x("_b"), x("_u"), x("_l")
    below = (d >= 2 * b) & (x("_place") <= 0.25) & (u <= 0.25 * b)
    above = (u >= 2 * b) & (x("_place") >= 0.75) & (d <= 0.25 * b)
    half = 0.5 * x("_mean")
    bodies = (x("_b2") > half) & (x("_b1") > half) & (b > half)
    inside_green = (o > x("open1")) & (c < x("close1")) & (o < x("close1")) & (c > x("open1"))
    inside_red = (o < x("open1")) & (c > x("close1")) & (o > x("close1")) & (c < x("open1"))
    near = lambda name: F.abs(x(f"{name}1") - x(name)) <= 0.01 * (x(f"{name}1") + x(name)) / 2
    mid2 = (x("open2") + x("close2")) / 2
    rules = {
        "doji": (x("_bp") < 0.05) & (u >= 2 * b) & (d >= 2 * b),
        "long_legged_doji": (x("_bp") < 0.05) & (u >= 3 * b) & (d >= 3 * b) & (x("_r") >= 1.5 * x("_avg")),
        "hammer": below & x("_down"),
        "inverted_hammer": above & x("_down"),
        "shooting_star": above & x("_up"),
        "hanging_man": below & x("_up"),
        "marubozu": (x("_us") < 0.05) & (x("_ls") < 0.05),
        "spinning_top": (x("_bp") < 0.25) & (u >= b) & (d >= b) & (F.abs(u - d) <= 0.3 * F.greatest(u, d)),
        "bullish_engulfing": x("_down1") & x("_g") & (o < x("close1")) & (c > x("open1")) & ((c - o) > (x("open1") - x("close1"))),
        "bearish_engulfing": x("_up1") & x("_k") & (o > x("close1")) & (c < x("open1")) & ((o - c) > (x("close1") - x("open1"))),
        "inside_bar": (h < x("high1")) & (low > x("low1")),
        "outside_bar": (h > x("high1")) & (low < x("low1")),
        "harami": (b < x("_b1")) & F.when(x("_g1"), inside_green).otherwise(inside_red),
        "tweezer_top": x("_up1") & x("_k") & near("high"),
        "tweezer_bottom": x("_down1") & x("_g") & near("low"),
        "morning_star": x("_down2") & x("_k2") & (x("_b1") < half) & (x("low1") < x("low2")) & x("_g") & (c > mid2),
        "evening_star": x("_up2") & x("_g2") & (x("_b1") < half) & (x("high1") > x("high2")) & x("_k") & (c < mid2),
        "three_white_soldiers": x("_g2") & x("_g1") & x("_g") & (x("close1") > x("close2")) & (c > x("close1")) & (x("open1") > x("open2")) & (x("open1") < x("close2")) & (o > x("open1")) & (o < x("close1")) & bodies,
        "three_black_crows": x("_k2") & x("_k1") & x("_k") & (x("close1") < x("close2")) & (c < x("close1")) & (x("open1") < x("open2")) & (x("open1") > x("close2")) & (o < x("open1")) & (o > x("close1")) & bodies,
    }
    return rows.withColumns({n: F.coalesce(rules[n], F.lit(False)) for n in TREND_AWARE}).select(*bars.columns, *TREND_AWARE)
