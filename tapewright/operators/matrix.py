"""The feature matrix: a wide row for each symbol and date, and what is read off it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import frame, full
from . import features

#: Columns of the matrix beside ``symbol, ts`` and the bar.
NAMES = (
    "return_1d", "return_3d", "return_5d", "return_10d", "return_20d", "return_60d", "rsi_14", "realized_vol_20", "realized_vol_60", "atr_pct", "dollar_volume_20", "volume_ratio_20",
    "dist_52w_low", "dist_52w_high", "sma_distance_20", "sma_distance_50", "sma_distance_200", "above_sma_20", "above_sma_50", "above_sma_200", "market_trend", "market_above_200",
)


def feature_matrix(bars: DataFrame) -> DataFrame:
    """Bars with all columns of ``NAMES``; the market is the mean close of a date."""
    out = features.volume(features.volatility(features.rsi_simple(features.trend(features.returns(bars)))))
    low, high = full(252, F.min("low"), frame(252)), full(252, F.max("high"), frame(252))
    out = out.withColumns({"atr_pct": F.col("atr_14") / F.col("close"), "dist_52w_low": F.col("close") / low - 1, "dist_52w_high": 1 - F.col("close") / high})
    market = features.market_regime(features.market_bar(bars)).select("ts", F.col("trend").cast("double").alias("market_trend"), F.col("above_200").alias("market_above_200"))
    return out.join(market, "ts", "left").select("symbol", "ts", "open", "high", "low", "close", "volume", *NAMES)


def trigger_proxies(n_days: int = 3, oversold: float = 30, overbought: float = 70, gap_pct: float = 2.0, within_pct: float = 5.0, multiple: float = 2.0) -> dict[str, Column]:
    """States of a matrix row that stand for a condition's event; false where a value is missing."""
    of_days = F.col(f"return_{n_days}d" if n_days in (1, 3, 5) else "return_5d")
    rules = {
        "consecutive_down": of_days < 0,
        "consecutive_up": of_days > 0,
        "oversold_rsi": F.col("rsi_14") <= oversold,
        "overbought_rsi": F.col("rsi_14") >= overbought,
        "gap_down": F.col("return_1d") <= -gap_pct / 100,
        "near_52w_low": F.col("dist_52w_low") <= within_pct / 100,
        "near_52w_high": F.col("dist_52w_high") <= within_pct / 100,
        "high_volume": F.col("volume_ratio_20") >= multiple,
    }
    return {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}


def trigger_stats(rows: DataFrame, triggers: list[str], outcome: str) -> DataFrame:
    """For each trigger the number, hit rate and mean of a known outcome, over all symbols."""
    fired = rows.where(F.col(outcome).isNotNull()).select(outcome, F.explode(F.filter(F.array(*[F.when(F.col(t), F.lit(t)) for t in triggers]), lambda x: x.isNotNull())).alias("pattern"))
    return fired.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(outcome) > 0).cast("double")).alias("hit_rate"), F.avg(outcome).alias("avg_return"))


def score_v1() -> Column:
    """Trend and momentum: 15, 20 and 25 points for the sides of three averages, 40 for RSI."""
    side = lambda n: F.coalesce(F.col(f"above_sma_{n}"), F.lit(0.0))
    momentum = F.least(F.greatest(F.coalesce("rsi_14", F.lit(50.0)) / 100 * 40, F.lit(0.0)), F.lit(40.0))
    return F.least(side(20) * 15 + side(50) * 20 + side(200) * 25 + momentum, F.lit(100.0))


def score_v2(average: str = "sma_distance_200", above: str = "above_sma_200") -> Column:
    """Mean reversion: oversold, quiet, near or below its average, no volume spike."""
    rsi, spike = F.coalesce("rsi_14", F.lit(50.0)), F.coalesce("volume_ratio_20", F.lit(1.0))
    zone = F.when(rsi < 30, 40.0).when(rsi < 40, 30.0).when(rsi < 50, 20.0).when(rsi < 60, 10.0).when(rsi < 70, 5.0).otherwise(0.0)
    calm = (1 - F.least(F.greatest(F.coalesce("realized_vol_20", F.lit(25.0)), F.lit(0.0)), F.lit(80.0)) / 80) * 30
    near = F.when(F.coalesce(above, F.lit(0.0)) == 0, 20.0).when(F.coalesce(average, F.lit(0.0)) < 0.05, 10.0).otherwise(0.0)
    loud = F.when(spike > 3, 20.0).when(spike > 2, 10.0).otherwise(0.0)
    return F.least(F.greatest(zone + calm + near - loud, F.lit(0.0)), F.lit(90.0))


#: Weights of the two scores by quality tier (fixed values); other tiers have 0.40 and 0.60.
TIER_WEIGHTS = {1: (0.20, 0.80), 2: (0.30, 0.70), 3: (0.50, 0.50), 4: (0.65, 0.35)}


def bucket_20(score: Column) -> Column:
    """Bands of 20 points; 100 is in the last."""
    return F.when(score < 20, "0-20").when(score < 40, "20-40").when(score < 60, "40-60").when(score < 80, "60-80").when(score.isNotNull(), "80-100")


def score_variants(rows: DataFrame, tier: Column) -> DataFrame:
    """Add four scores of a matrix row and their bands."""
    rows = rows.withColumns({"score_v1_current": score_v1(), "score_v2_mean_reversion": score_v2(), "_tier": tier})
    first, second = F.lit(0.40), F.lit(0.60)
    for number, (a, b) in TIER_WEIGHTS.items():
        first, second = F.when(F.col("_tier") == number, a).otherwise(first), F.when(F.col("_tier") == number, b).otherwise(second)
    v1, v2 = F.col("score_v1_current"), F.col("score_v2_mean_reversion")
    rows = rows.withColumns({"score_v3_hybrid": 0.4 * v1 + 0.6 * v2, "score_v4_tier_adjusted": first * v1 + second * v2}).drop("_tier")
    return rows.withColumns({f"bucket_{n}": bucket_20(F.col(f"score_{n}")) for n in VARIANTS})


VARIANTS = ("v1_current", "v2_mean_reversion", "v3_hybrid", "v4_tier_adjusted")


def component_scores(rows: DataFrame, patterns: str = "patterns", breakouts: tuple[str, ...] = ()) -> DataFrame:
    """Add 0-100 components from ``atr_pct`` (in percent), an array of pattern names, ``pullback_class`` and ``rs_score``.

    ``flags_bull`` and ``flags_bear`` count components at 70 or more and 30 or less.
    """
    n, found = F.size(patterns), F.size(F.array_intersect(patterns, F.array(*[F.lit(b) for b in breakouts])))
    base = F.when(F.lower("pullback_class") == "pullback", 70.0).when(F.lower("pullback_class") == "reversal", 20.0).otherwise(45.0)
    parts = {
        "volatility_component": F.round((1 - F.greatest(F.lit(0.0), F.least("atr_pct", F.lit(15.0))) / 15) * 100, 1),
        "pattern_component": F.when(n == 0, 0.0).when(n == 1, 30.0).when(n == 2, 55.0).when(n == 3, 70.0).otherwise(F.least(85.0 + (n - 4) * 5.0, F.lit(100.0))),
        "breakout_component": F.when(found == 0, 0.0).when(found == 1, 60.0).otherwise(100.0),
        "support_component": F.round(F.coalesce(base * 0.6 + F.col("rs_score") * 0.4, base), 1),
    }
    parts["volatility_component"] = F.when(F.col("atr_pct").isNotNull(), parts["volatility_component"])
    out = rows.withColumns(parts)
    count = lambda rule: sum((F.when(rule(F.col(c)), 1).otherwise(0) for c in parts), F.lit(0))
    return out.withColumns({"flags_bull": count(lambda c: c >= 70), "flags_bear": count(lambda c: c <= 30)})


def export_snapshot(rows: DataFrame, names: list[str], drivers: list[str]) -> DataFrame:
    """One record for each row: the known features as JSON (6 digits), the first three known drivers, and the counts."""
    items = F.array(*[F.struct(F.lit(n).alias("name"), F.round(F.col(n), 6).alias("value")) for n in sorted(names)])
    known = F.filter(items, lambda x: x["value"].isNotNull())
    top = F.slice(F.filter(F.array(*[F.when(F.col(d).isNotNull(), F.lit(d)) for d in drivers]), lambda x: x.isNotNull()), 1, 3)
    return rows.select("symbol", "ts", F.to_json(F.map_from_entries(known)).alias("features"), F.array_join(top, "|").alias("top_drivers"), F.size(known).alias("present"), (len(names) - F.size(known)).alias("missing"))
