"""Every condition by its name: window conditions, candles, and those on recursive indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.recurrences import Indicator, with_indicators
from ..functions.windows import by_symbol, frame, lag
from . import conditions, features, patterns

#: Other names of candlestick patterns (fixed values).
CANDLE_NAMES = {"bullish_engulfing": "engulfing_bull", "bearish_engulfing": "engulfing_bear"}


def _crossed(value: Column, level: Column, up: bool) -> Column:
    before = F.lag(value).over(by_symbol()) - F.lag(level).over(by_symbol())
    now = value - level
    return (now > 0) & (before <= 0) if up else (now < 0) & (before >= 0)


def _held(rule: Column, n: int) -> Column:
    return F.sum(F.coalesce(rule, F.lit(False)).cast("int")).over(frame(n)) == n


def _on_average(rows: DataFrame, name: str, value: str, n_days: int, touch_pct: float, slope_bars: int) -> Column:
    close, v = F.col("close"), F.col(value)
    kind = name.split("_", 1)[1].removeprefix("lows_")
    return {
        "cross_up": lambda: _crossed(close, v, True), "cross_down": lambda: _crossed(close, v, False),
        "green_nd": lambda: _held(close > v, n_days), "red_nd": lambda: _held(close < v, n_days), "above_nd": lambda: _held(close > v, n_days),
        "support": lambda: (F.abs(F.col("low") / v - 1) <= touch_pct) & (close > v) & (close > F.col("open")),
        "green_slope": lambda: (close > v) & (v > lag(value, slope_bars)),
    }[kind]()


def evaluate(bars: DataFrame, condition: str, pattern: str = "", threshold: float | None = None, period: int | None = None, n_days: int = 3, touch_pct: float = 0.005, slope_bars: int = 5, **params) -> DataFrame:
    """``bars`` with the boolean column ``signal`` of any named condition.

    Names beside those of :mod:`conditions`: ``candle`` (``pattern``), ``oversold_rsi``
    and ``overbought_rsi`` (Wilder's), ``omni_*`` (mean of closes), ``ema_lows_*`` (mean of
    lows), ``hma_*`` (Hull's mean) and ``oscar_*`` (smoothed stochastic against 50).
    """
    kept = bars.columns
    if condition == "candle":
        name = CANDLE_NAMES.get(pattern, pattern)
        if name in ("inside_day", "outside_day"):
            return conditions.evaluate(bars, name)
        if name not in patterns.BIAS:
            raise ValueError(f"no pattern is named {pattern}")
        return patterns.candlestick_patterns(bars).select(*kept, F.col(name).alias("signal"))
    if condition in ("oversold_rsi", "overbought_rsi"):
        rows = with_indicators(bars, [Indicator("_v", "rsi", period or 14)])
        rule = F.col("_v") <= (30 if threshold is None else threshold) if condition == "oversold_rsi" else F.col("_v") >= (70 if threshold is None else threshold)
    elif condition.startswith("omni_"):
        rows = with_indicators(bars, [Indicator("_v", "ema", period or 87)])
        rule = _on_average(rows, condition, "_v", n_days, touch_pct, slope_bars)
    elif condition.startswith("ema_lows_"):
        rows = with_indicators(bars, [Indicator("_v", "ema", period or 82, "low")])
        rule = _on_average(rows, condition.removeprefix("ema_"), "_v", n_days, touch_pct, slope_bars)
    elif condition.startswith("hma_"):
        rows = features.hull(bars, period or 87, "_v")
        rule = _on_average(rows, condition, "_v", n_days, touch_pct, slope_bars)
    elif condition.startswith("oscar_"):
        rows = with_indicators(bars, [Indicator("_v", "stochastic", period or 87)])
        fifty = F.lit(50.0)
        rule = F.col("_v") > 50 if condition == "oscar_above_50" else _crossed(F.col("_v"), fifty, condition == "oscar_cross_up")
    else:
        return conditions.evaluate(bars, condition, **params)
    return rows.withColumn("signal", F.coalesce(rule, F.lit(False))).select(*kept, "signal")


def spec_runner(bars: DataFrame, spec: dict, horizons: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One condition with a direction: per horizon and year, and over all years, number, hit rate and mean of the directed return."""
    rows = evaluate(bars, spec["condition"], **spec.get("params", {}))
    side = -1.0 if spec.get("direction") == "short" else 1.0
    later = F.array(*[F.struct(F.lit(h).alias("horizon"), ((F.lead("close", h).over(by_symbol()) / F.col("close") - 1) * 100 * side).alias("ret")) for h in horizons])
    long = rows.select("signal", F.year("ts").alias("year"), later.alias("_l")).where("signal").select("year", F.inline("_l")).where("ret is not null")
    sets = long.groupingSets([[F.col("horizon"), F.col("year")], [F.col("horizon")]], F.col("horizon"), F.col("year"))
    return sets.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"), F.avg("ret").alias("mean"))
