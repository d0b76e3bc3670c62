"""Features and conditions on recursive indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.recurrences import Indicator, with_indicators
from ..functions.windows import by_symbol, frame, lag


def _cross(above: Column, up: bool) -> Column:
    before = F.lag(above).over(by_symbol())
    return F.coalesce((above & ~before) if up else (~above & before), F.lit(False))


def low_ema_features(bars: DataFrame, n: int = 82) -> DataFrame:
    """Mean of the lows: value, side, distance, slopes over 5 and 10 bars, change of distance, bounce."""
    name = f"low_ema_{n}"
    rows = with_indicators(bars, [Indicator(name, "ema", n, "low")])
    v = F.col(name)
    rows = rows.withColumns({f"{name}_above": (F.col("close") > v).cast("double"), f"{name}_distance": F.col("close") / v - 1, f"{name}_slope_5": v / lag(v, 5) - 1, f"{name}_slope_10": v / lag(v, 10) - 1})
    bounce = (F.abs(F.col("low") / v - 1) <= 0.005) & (F.col("close") > F.col("open"))
    return rows.withColumns({f"{name}_distance_5": F.col(f"{name}_distance") - lag(f"{name}_distance", 5), f"{name}_bounce": bounce.cast("double")})


def stochastic_features(bars: DataFrame, n: int = 87) -> DataFrame:
    name = f"stoch_{n}"
    rows = with_indicators(bars, [Indicator(name, "stochastic", n)])
    return rows.withColumn(f"{name}_above_50", (F.col(name) > 50).cast("double"))


def tier_adjusted_signal(above: Column, tier: Column) -> Column:
    """+1 or -1 by side; nothing in tier 3, turned round in tier 4."""
    side = F.when(above > 0, 1).when(above == 0, -1)
    return F.when(tier == 3, 0).when(tier == 4, -side).otherwise(side)


def oscillator_masks(bars: DataFrame, low: float = 30, high: float = 70, n: int = 14) -> DataFrame:
    """Oversold and overbought by Wilder's RSI, and crosses of the MACD histogram through zero."""
    rows = with_indicators(bars, [Indicator("rsi_wilder", "rsi", n), Indicator("macd_histogram", "macd")])
    positive = F.col("macd_histogram") > 0
    return rows.withColumns(
        {
            "oversold": F.coalesce(F.col("rsi_wilder") < low, F.lit(False)),
            "overbought": F.coalesce(F.col("rsi_wilder") > high, F.lit(False)),
            "macd_cross_up": _cross(positive, True),
            "macd_cross_down": _cross(positive, False),
        }
    )


def average_masks(bars: DataFrame, n: int = 82, touch: float = 0.005, days: int = 3) -> DataFrame:
    """Crosses of the mean of lows, days in a row above it, and touches from above on a green bar."""
    rows = low_ema_features(bars, n)
    v = F.col(f"low_ema_{n}")
    above = F.col("close") > v
    held = F.sum(F.coalesce(above.cast("int"), F.lit(0))).over(frame(days)) == days
    support = (F.abs(F.col("low") / v - 1) <= touch) & above & (F.col("close") > F.col("open"))
    return rows.withColumns({"cross_up": _cross(above, True), "cross_down": _cross(above, False), "above_nd": F.coalesce(held, F.lit(False)), "support": F.coalesce(support, F.lit(False))})


def indicator_fit(bars: DataFrame, specs: list[Indicator]) -> DataFrame:
    """Per indicator: share of bars with it at or above the low, inside the range, mean distance, share of closes below."""
    rows = with_indicators(bars, specs)
    long = rows.select("low", "high", "close", F.inline(F.array(*[F.struct(F.lit(s.name).alias("indicator"), F.col(s.name).alias("v")) for s in specs]))).where("v is not null")
    share = lambda c: 100 * F.avg(c.cast("int"))
    return long.groupBy("indicator").agg(
        F.count(F.lit(1)).alias("n"), share(F.col("v") >= F.col("low")).alias("at_or_above_low"), share(F.col("v").between(F.col("low"), F.col("high"))).alias("inside"),
        F.avg(F.abs(F.col("close") / F.col("v") - 1) * 100).alias("mean_distance"), share(F.col("close") < F.col("v")).alias("closes_below"),
    )


def candle_behaviors(bars: DataFrame) -> DataFrame:
    """Long form of fired behaviours with an intensity from 0 to 1."""
    specs = [Indicator("e9", "ema", 9), Indicator("e20", "ema", 20), Indicator("e50", "ema", 50), Indicator("rsi", "rsi", 14), Indicator("macd", "macd")]
    rows = with_indicators(bars, specs)
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    jump = F.col("open") / lag("close") - 1
    mean = F.avg("volume").over(frame(20, -1))
    found = {
        "gap_up": (jump > 0.02, unit(jump * 10)),
        "gap_down": (jump < -0.02, unit(-jump * 10)),
        "ema_stack_up": ((F.col("e9") > F.col("e20")) & (F.col("e20") > F.col("e50")), unit((F.col("e9") / F.col("e50") - 1) * 10)),
        "ema_stack_down": ((F.col("e9") < F.col("e20")) & (F.col("e20") < F.col("e50")), unit((1 - F.col("e9") / F.col("e50")) * 10)),
        "rsi_reclaim": ((F.col("rsi") > 30) & (lag("rsi") <= 30), unit((F.col("rsi") - 30) / 20)),
        "rsi_overbought": (F.col("rsi") > 70, unit((F.col("rsi") - 70) / 30)),
        "macd_cross_up": ((F.col("macd") > 0) & (lag("macd") <= 0), F.lit(1.0)),
        "macd_cross_down": ((F.col("macd") < 0) & (lag("macd") >= 0), F.lit(1.0)),
        "volume_surge": (F.col("volume") > 1.5 * mean, unit(F.col("volume") / mean / 5)),
        "inside_day": ((F.col("high") < lag("high")) & (F.col("low") > lag("low")), F.lit(1.0)),
    }
    rows = rows.withColumns({f"_{n}": F.when(rule, intensity) for n, (rule, intensity) in found.items()})
    items = F.array(*[F.struct(F.lit(n).alias("behavior"), F.col(f"_{n}").alias("intensity")) for n in found])
    return rows.select("symbol", "ts", F.inline(items)).where("intensity is not null")


def behavior_interactions(behaviors: DataFrame, outcomes: DataFrame, least: int = 10) -> DataFrame:
    """Pairs of behaviours on one bar: size, hit rate and lift over each alone.

    A bar fires at most each behaviour once, so its pairs are bounded by the
    square of the catalogue, whatever the size of the table.
    """
    hits = outcomes.where("ret is not null").select("symbol", "ts", (F.col("ret") > 0).cast("int").alias("hit"))
    rows = behaviors.select("symbol", "ts", "behavior").distinct().join(hits, ["symbol", "ts"])
    alone = rows.groupBy("behavior").agg(F.avg("hit").alias("hit_rate"))
    sets = rows.groupBy("symbol", "ts", "hit").agg(F.array_sort(F.collect_set("behavior")).alias("s"))
    one = sets.select("hit", "s", F.posexplode("s").alias("i", "a"))
    pairs = one.select("hit", "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    out = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("hit_rate")).where(F.col("n") >= least)
    out = out.join(alone.select(F.col("behavior").alias("a"), F.col("hit_rate").alias("hit_a")), "a").join(alone.select(F.col("behavior").alias("b"), F.col("hit_rate").alias("hit_b")), "b")
    return out.withColumns({"lift_a": F.col("hit_rate") - F.col("hit_a"), "lift_b": F.col("hit_rate") - F.col("hit_b")})


def behavior_stats(behaviors: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per behaviour and horizon: number, hit rate, mean, profit factor (at most 99) and deviation of the return in percent."""
    later = F.array(*[F.struct(F.lit(h).alias("horizon"), ((F.lead("close", h).over(by_symbol()) / F.col("close") - 1) * 100).alias("ret")) for h in horizons])
    rows = behaviors.select("symbol", "ts", "behavior").join(bars.select("symbol", "ts", later.alias("_l")), ["symbol", "ts"]).select("behavior", F.inline("_l")).where("ret is not null")
    out = rows.groupBy("behavior", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"),
        F.coalesce(F.sum(F.when(F.col("ret") > 0, F.col("ret"))), F.lit(0.0)).alias("_w"), F.coalesce(-F.sum(F.when(F.col("ret") <= 0, F.col("ret"))), F.lit(0.0)).alias("_l"),
    )
    factor = F.when(F.col("_l") > 0, F.least(F.col("_w") / F.nullif(F.col("_l"), F.lit(0.0)), F.lit(99.0))).otherwise(99.0)
    return out.withColumns({"profit_factor": factor, "std": F.when(F.col("n") > 1, F.col("std"))}).drop("_w", "_l")


def momentum_features(bars: DataFrame) -> DataFrame:
    """Intraday momentum, all smoothed from the first bar: means of 9, 20 and 50 bars with slopes, RSI, MACD with crosses, ATR and compression."""
    before = lag("close")
    rows = bars.withColumns({"_d": F.col("close") - before, "_tr": F.greatest(F.col("high") - F.col("low"), F.coalesce(F.abs(F.col("high") - before), F.lit(0.0)), F.coalesce(F.abs(F.col("low") - before), F.lit(0.0)))})
    rows = rows.withColumns({"_up": F.greatest(F.coalesce("_d", F.lit(0.0)), F.lit(0.0)), "_down": F.greatest(-F.coalesce("_d", F.lit(0.0)), F.lit(0.0))})
    specs = [Indicator(f"ema{n}", "ewm", n) for n in (9, 20, 50)] + [Indicator("_12", "ewm", 12), Indicator("_26", "ewm", 26), Indicator("_g", "ewm", 14, "_up"), Indicator("_l", "ewm", 14, "_down"), Indicator("atr14", "ewm", 14, "_tr"), Indicator("_sig", "macd_signal")]
    rows = with_indicators(rows, specs)
    rows = rows.withColumns({"ema9_slope": F.col("ema9") - lag("ema9", 3), "ema20_slope": F.col("ema20") - lag("ema20", 3), "macd": F.col("_12") - F.col("_26"), "macd_hist": F.col("_12") - F.col("_26") - F.col("_sig")})
    rows = rows.withColumn("rsi14", F.when(before.isNotNull() & (F.col("_l") != 0), 100 - 100 / (1 + F.col("_g") / F.nullif(F.col("_l"), F.lit(0.0)))))
    side, earlier = F.round("macd_hist", 9), lag(F.round("macd_hist", 9))
    quiet = F.when(F.count("atr14").over(frame(20)) == 20, F.avg("atr14").over(frame(20)))
    known = lambda c: F.coalesce(c, F.lit(False))
    return rows.withColumns(
        {
            "rsi_reclaim_bull": known((F.col("rsi14") >= 40) & (lag("rsi14") < 35)), "rsi_reclaim_bear": known((F.col("rsi14") <= 60) & (lag("rsi14") > 65)),
            "macd_bull_cross": known((side > 0) & (earlier <= 0)), "macd_bear_cross": known((side < 0) & (earlier >= 0)), "compressed": known(F.col("atr14") < 0.75 * quiet),
        }
    ).drop("_d", "_tr", "_up", "_down", "_12", "_26", "_g", "_l", "_sig")


def compare_indicators(bars: DataFrame, specs: list[Indicator], horizon: int = 5) -> DataFrame:
    """Variants of an average side by side: how they fit the bars, and hit rate and mean log return after a close crosses above, ranked by both."""
    fit = indicator_fit(bars, specs)
    rows = with_indicators(bars, specs)
    later = F.log(F.lead("close", horizon).over(by_symbol()) / F.col("close"))
    pairs = F.array(*[F.struct(F.lit(s.name).alias("indicator"), _cross(F.col("close") > F.col(s.name), True).alias("up")) for s in specs])
    long = rows.select(later.alias("r"), pairs.alias("_p")).select("r", F.inline("_p")).where("up and r is not null")
    crosses = long.groupBy("indicator").agg(F.count(F.lit(1)).alias("n_cross"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"), F.avg("r").alias("mean_return"))
    out = fit.join(crosses, "indicator", "left")
    # As many rows as variants.
    order = Window.orderBy(F.desc(F.round("hit_rate", 9)), F.round("mean_distance", 9), "indicator")
    return out.withColumn("rank", F.row_number().over(order))
