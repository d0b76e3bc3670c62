"""Boolean conditions on bars. Each builder gives a column that is false where it can't be known."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import by_symbol, frame, full, lag
from .features import log_return, sma


def known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def consecutive(n: int, up: bool) -> Column:
    step = F.col("close") > lag("close") if up else F.col("close") < lag("close")
    return known(F.sum(F.coalesce(step.cast("int"), F.lit(0))).over(frame(n)) == n)


def gap(percent: float, up: bool) -> Column:
    move = (F.col("open") / lag("close") - 1) * 100
    return known(move >= percent if up else move <= -percent)


def near_extreme(percent: float, high: bool, window: int = 252) -> Column:
    """Within ``percent`` of the highest high or the lowest low of up to ``window`` bars."""
    over = by_symbol().rowsBetween(-(window - 1), 0)
    if high:
        return known(F.col("close") >= F.max("high").over(over) * (1 - percent / 100))
    return known(F.col("close") <= F.min("low").over(over) * (1 + percent / 100))


def breakout(window: int = 252) -> Column:
    return known(F.col("close") > full(window, F.max("high"), frame(window, -1)))


def above_level(level: float) -> Column:
    return known(F.col("close") > level)


def side_of_sma(n: int, above: bool) -> Column:
    return known(F.col("close") > sma(n) if above else F.col("close") < sma(n))


def high_volume(times: float, lookback: int = 20) -> Column:
    return known(F.col("volume") >= times * full(lookback, F.avg("volume"), frame(lookback)))


def volume_climax(times: float, up: bool, lookback: int = 20) -> Column:
    body = F.col("close") > F.col("open") if up else F.col("close") < F.col("open")
    return high_volume(times, lookback) & known(body)


def narrow_range(lookback: int = 7) -> Column:
    size = F.col("high") - F.col("low")
    return known(size < full(lookback - 1, F.min(size), frame(lookback - 1, -1)))


def inside_bar() -> Column:
    return known((F.col("high") < lag("high")) & (F.col("low") > lag("low")))


def outside_bar() -> Column:
    return known((F.col("high") > lag("high")) & (F.col("low") < lag("low")))


def month_edge(n: int, end: bool) -> Column:
    """Among the first or last ``n`` bars of a month in the data."""
    month = Window.partitionBy("symbol", F.trunc("ts", "month"))
    return F.row_number().over(month.orderBy(F.desc("ts") if end else F.asc("ts"))) <= n


def day_of_week(day: int) -> Column:
    return F.weekday("ts") == day


def return_beyond(n: int, threshold: float, above: bool) -> Column:
    r = log_return(n)
    return known(r > threshold if above else r < threshold)


def volatility_expansion(short: int = 5, long: int = 20, times: float = 1.5) -> Column:
    part = lambda n: F.when(F.count("_r").over(frame(n)) == n, F.stddev_samp("_r").over(frame(n)))
    return known(part(short) > times * part(long))


#: Names under which conditions are looked up; every builder takes keyword parameters.
CATALOGUE: dict[str, Callable[..., Column]] = {
    "consecutive_down": lambda n=3: consecutive(n, False),
    "consecutive_up": lambda n=3: consecutive(n, True),
    "gap_down": lambda min_gap_pct=2.0: gap(min_gap_pct, False),
    "gap_up": lambda min_gap_pct=2.0: gap(min_gap_pct, True),
    "near_52w_low": lambda pct=5.0: near_extreme(pct, False),
    "near_52w_high": lambda pct=5.0: near_extreme(pct, True),
    "breakout_52w_high": lambda: breakout(),
    "above_level": lambda level: above_level(level),
    "below_sma": lambda n=200: side_of_sma(n, False),
    "above_sma": lambda n=50: side_of_sma(n, True),
    "high_volume": lambda mult=2.0, lookback=20: high_volume(mult, lookback),
    "volume_climax_down": lambda mult=2.0, lookback=20: volume_climax(mult, False, lookback),
    "volume_climax_up": lambda mult=2.0, lookback=20: volume_climax(mult, True, lookback),
    "nr7": lambda lookback=7: narrow_range(lookback),
    "inside_day": inside_bar,
    "outside_day": outside_bar,
    "end_of_month": lambda n=3: month_edge(n, True),
    "turn_of_month": lambda n=3: month_edge(n, False),
    "day_of_week": lambda day=0: day_of_week(day),
    "return_above_threshold": lambda n=5, threshold=0.1: return_beyond(n, threshold, True),
    "return_below_threshold": lambda n=5, threshold=-0.1: return_beyond(n, threshold, False),
    "volatility_expansion": lambda: volatility_expansion(),
}
#: Other names of parameters.
ALIASES = {"n_days": "n", "threshold_pct": "min_gap_pct", "window": "n", "multiplier": "mult"}


def evaluate(bars: DataFrame, condition: str, **params) -> DataFrame:
    """``bars`` with the boolean column ``signal`` of a named condition."""
    if condition not in CATALOGUE:
        raise ValueError(f"no condition is named {condition}")
    rows = bars.withColumn("_r", log_return(1))
    return rows.withColumn("signal", CATALOGUE[condition](**{ALIASES.get(k, k): v for k, v in params.items()})).drop("_r")


def masks(bars: DataFrame, specs: dict[str, tuple[str, dict]]) -> DataFrame:
    """Many conditions as columns of one plan: ``{column: (condition, params)}``."""
    rows = bars.withColumn("_r", log_return(1))
    columns = {name: CATALOGUE[c](**{ALIASES.get(k, k): v for k, v in p.items()}) for name, (c, p) in specs.items()}
    return rows.withColumns(columns).drop("_r")


def find_signals(bars: DataFrame, specs: dict[str, tuple[str, dict]]) -> DataFrame:
    """Bars on which all conditions hold."""
    rows = masks(bars, specs)
    return rows.where(reduce(lambda a, b: a & b, [F.col(n) for n in specs])).drop(*specs)


def streaks(bars: DataFrame) -> DataFrame:
    """Signed length of the current run of rising or falling closes (gaps and islands)."""
    step = F.signum(F.col("close") - lag("close"))
    rows = bars.withColumn("_s", F.coalesce(step, F.lit(0.0)).cast("int"))
    turn = F.coalesce(F.col("_s") != lag("_s"), F.lit(True)).cast("int")
    rows = rows.withColumn("_run", turn).withColumn("_run", F.sum("_run").over(by_symbol()))
    place = F.row_number().over(Window.partitionBy("symbol", "_run").orderBy("ts"))
    return rows.withColumn("streak", (place * F.col("_s")).cast("int")).drop("_s", "_run")


def near_calendar_day(bars: DataFrame, days: DataFrame, within: int) -> DataFrame:
    """Bars within some calendar days of a listed date: the dates are spread over the days around them and joined by day."""
    around = F.sequence(F.date_sub("date", within), F.date_add("date", within))
    near = days.select(F.explode(around).alias("_d")).distinct()
    return bars.withColumn("_d", F.to_date("ts")).join(near, "_d", "left_semi").drop("_d")


def same_week(bars: DataFrame, days: DataFrame) -> DataFrame:
    """Bars in the Monday-based week of a listed date."""
    weeks = days.select(F.date_trunc("week", "date").alias("_w")).distinct()
    return bars.withColumn("_w", F.date_trunc("week", "ts")).join(weeks, "_w", "left_semi").drop("_w")


def outperformance(bars: DataFrame, a: str, b: str, percent: float, n: int) -> DataFrame:
    """Dates common to two symbols on which one's ``n``-bar return beats the other's by ``percent`` points."""
    side = lambda s, c: bars.where(F.col("symbol") == s).select("ts", F.col("close").alias(c))
    both = side(a, "_a").join(side(b, "_b"), "ts").withColumn("symbol", F.lit(a))
    lead = (F.col("_a") / lag("_a", n) - F.col("_b") / lag("_b", n)) * 100
    return both.withColumn("lead", lead).where(F.col("lead") >= percent).select("ts", "lead")


def sector_leading(bars: DataFrame, strength: DataFrame, sector: str, rank: int, n: int) -> DataFrame:
    """Bars with ``signal``: the sector's rank was at most ``rank`` on each of the last ``n`` bars; a missing rank is 99."""
    ranks = strength.where(F.col("symbol") == sector).select("ts", F.col("rank_20d").alias("_k"))
    ok = (F.coalesce("_k", F.lit(99)) <= rank).cast("int")
    return bars.join(ranks, "ts", "left").withColumn("_ok", ok).withColumn("signal", F.sum("_ok").over(frame(n)) == n).drop("_k", "_ok")


def pair_strength(strength: DataFrame, a: str, b: str) -> DataFrame:
    """``ts, signal``: whether one sector's 20-bar strength is above another's; false where one is unknown."""
    one, other = (strength.where(F.col("symbol") == x).select("ts", F.col("rs_20d").alias(n)) for x, n in ((a, "_a"), (b, "_b")))
    return one.join(other, "ts").select("ts", F.coalesce(F.col("_a") > F.col("_b"), F.lit(False)).alias("signal"))
