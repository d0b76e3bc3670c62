"""What happened after a bar: forward returns, paths, labels, events and their statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import ahead, by_symbol, lag, lead

HORIZONS = (1, 3, 5, 10, 20)


def forward_return(h: int, kind: str = "pct") -> Column:
    """Return ``h`` bars later: ``log``, ``pct`` (times 100) or ``simple``."""
    later = lead("close", h)
    if kind == "log":
        return F.when((later > 0) & (F.col("close") > 0), F.log(later / F.col("close")))
    return (later / F.col("close") - 1) * (100 if kind == "pct" else 1)


def forward_returns(bars: DataFrame, horizons: Iterable[int] = HORIZONS, kind: str = "pct") -> DataFrame:
    return bars.withColumns({f"fwd_{h}d": forward_return(h, kind) for h in horizons})


def path_stats(bars: DataFrame, windows: Iterable[int] = (5, 20), whole: bool = False) -> DataFrame:
    """Largest rise and fall within the next bars, in percent; ``whole`` asks for the full window."""
    out = {}
    for w in windows:
        over = ahead(1, w)
        up = (F.max("high").over(over) / F.col("close") - 1) * 100
        down = (F.min("low").over(over) / F.col("close") - 1) * 100
        enough = F.count(F.lit(1)).over(over) == w
        out |= {f"max_runup_{w}d": F.when(enough, up) if whole else up, f"max_drawdown_{w}d": F.when(enough, down) if whole else down}
    return bars.withColumns(out)


def forward_labels(bars: DataFrame) -> DataFrame:
    """Log returns over 1 to 60 bars, their signs and the 20-bar extremes, where 60 later bars exist."""
    out = bars.withColumns({f"return_{h}d": forward_return(h, "log") for h in (1, 5, 10, 20, 60)})
    over = ahead(1, 20)
    out = out.withColumns(
        {f"positive_{h}d": F.col(f"return_{h}d") > 0 for h in (1, 5, 10, 20, 60)}
        | {"max_runup_20d": F.log(F.max("high").over(over) / F.col("close")), "max_drawdown_20d": F.log(F.min("low").over(over) / F.col("close"))}
    )
    return out.where(F.col("return_60d").isNotNull())


def signal_events(bars: DataFrame, signal: str = "signal", horizons: Iterable[int] = HORIZONS, windows: Iterable[int] = (5, 20)) -> DataFrame:
    """Bars on which a signal fired and the longest horizon is known, with returns and paths."""
    rows = path_stats(forward_returns(bars, horizons), windows)
    return rows.where(F.col(signal) & F.col(f"fwd_{max(horizons)}d").isNotNull())


def long_outcomes(events: DataFrame, keep: Iterable[str], horizons: Iterable[int] = HORIZONS) -> DataFrame:
    """One row for each event and horizon: ``horizon, ret``."""
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}d").alias("ret")) for h in horizons])
    return events.select(*keep, F.inline(pairs)).where(F.col("ret").isNotNull())


def event_stats(events: DataFrame, by: Iterable[str] = (), horizons: Iterable[int] = HORIZONS) -> DataFrame:
    """Count, hit rate, mean, median, deviation, quartiles, Sharpe ratio and two-tailed p by horizon."""
    by = list(by)
    rows = long_outcomes(events, by, horizons)
    out = rows.groupBy(*by, "horizon").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("ret") > 0).cast("int")).alias("hit_rate"),
        F.avg("ret").alias("mean"),
        F.percentile("ret", F.lit(0.5)).alias("median"),
        F.stddev_samp("ret").alias("std"),
        F.percentile("ret", F.lit(0.25)).alias("p25"),
        F.percentile("ret", F.lit(0.75)).alias("p75"),
    )
    out = out.withColumn("std", F.when(F.col("n") > 1, F.col("std")))
    return out.withColumns(
        {"sharpe": F.when(F.col("std") > 0, F.col("mean") / F.col("std") * F.sqrt(252.0 / F.col("horizon"))), "p_value": tstat_p(F.col("n"), F.col("mean"), F.col("std"))}
    )


def normal_tail(z: Column) -> Column:
    """P(|Z| > z) by the five-term polynomial of Abramowitz and Stegun, 26.2.17."""
    # Fixed values of the published approximation.
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    x = F.abs(z)
    t = 1 / (1 + p * x)
    poly = F.lit(0.0)
    for c in reversed(b):
        poly = (poly + c) * t
    return 2 * F.exp(-x * x / 2) / F.sqrt(F.lit(2 * 3.141592653589793)) * poly


def tstat_p(n: Column, mean: Column, std: Column) -> Column:
    """Two-tailed p of a mean by the normal approximation; null under two rows or without spread."""
    return F.when((n > 1) & (std > 0), normal_tail(mean / (std / F.sqrt(n))))


def binomial_p(n: Column, hits: Column, p: float = 0.5) -> Column:
    """One-tailed p of at least so many hits, with continuity correction."""
    z = (hits - 0.5 - n * p) / F.sqrt(n * p * (1 - p))
    return F.when(n > 0, F.when(z >= 0, normal_tail(z) / 2).otherwise(1 - normal_tail(z) / 2))


def yearly_breakdown(events: DataFrame, horizon: int, by: Iterable[str] = (), least: int = 3) -> DataFrame:
    c = f"fwd_{horizon}d"
    out = events.where(F.col(c).isNotNull()).groupBy(*by, F.year("ts").alias("year"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(c) > 0).cast("int")).alias("hit_rate"), F.avg(c).alias("mean")).where(F.col("n") >= least)


def robustness(events: DataFrame, horizon: int, by: Iterable[str]) -> DataFrame:
    """Four checks: 30 events, three years, an edge without the best year, an edge after winsorising."""
    by, c = list(by), f"fwd_{horizon}d"
    rows = events.where(F.col(c).isNotNull()).select(*by, F.year("ts").alias("year"), F.col(c).alias("ret"))
    years = rows.groupBy(*by, "year").agg(F.sum("ret").alias("s"), F.count(F.lit(1)).alias("k"))
    best = F.max(F.struct((F.col("s") / F.col("k")).alias("m"), "year", "s", "k"))
    total = years.groupBy(*by).agg(F.sum("s").alias("s"), F.sum("k").alias("n"), F.count(F.lit(1)).alias("years"), best.alias("b"))
    total = total.withColumn("mean_without_best", (F.col("s") - F.col("b.s")) / F.nullif(F.col("n") - F.col("b.k"), F.lit(0)))
    cuts = rows.groupBy(*by).agg(F.percentile("ret", F.lit(0.05)).alias("lo"), F.percentile("ret", F.lit(0.95)).alias("hi"))
    wins = rows.join(cuts, by).groupBy(*by).agg(F.avg(F.least(F.greatest("ret", "lo"), F.col("hi"))).alias("mean_winsorised"))
    out = total.join(wins, by).withColumn("mean", F.col("s") / F.col("n"))
    checks = [F.col("n") >= 30, F.col("years") >= 3, known_positive("mean_without_best"), known_positive("mean_winsorised")]
    score = sum((c.cast("int") for c in checks), F.lit(0)) / 4
    return out.select(*by, "n", "years", "mean", "mean_without_best", "mean_winsorised", score.alias("score"))


def known_positive(c: str) -> Column:
    return F.coalesce(F.col(c) > 0, F.lit(False))


def classify_status(n: Column, hit: Column, p: Column, years: Column) -> Column:
    promoted = (n >= 50) & (hit > 0.54) & (p < 0.05) & (years >= 3)
    candidate = (n >= 20) & (hit > 0.52) & (p < 0.10)
    return F.when(promoted, "promoted").when(candidate, "candidate").otherwise("rejected")


def trade_metrics(trades: DataFrame, by: Iterable[str], ret: str = "ret", order: Iterable[str] = ("ts", "symbol")) -> DataFrame:
    """Count, win rate, expectancy, profit factor (at most 5), mean win and loss, worst fall of the running sum."""
    by = list(by)
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumn("_sum", F.sum(ret).over(run)).withColumn("_top", F.greatest(F.max("_sum").over(run), F.lit(0.0)))
    win, loss = F.when(F.col(ret) > 0, F.col(ret)), F.when(F.col(ret) <= 0, F.col(ret))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(ret) > 0).cast("int")).alias("win_rate"), F.avg(ret).alias("expectancy"),
        F.sum(win).alias("_w"), (-F.sum(loss)).alias("_l"), F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"), F.max(F.col("_top") - F.col("_sum")).alias("max_drawdown"),
    )
    w, x = F.coalesce("_w", F.lit(0.0)), F.coalesce("_l", F.lit(0.0))
    return out.withColumn("profit_factor", F.when(x > 0, F.least(w / x, F.lit(5.0))).otherwise(F.when(w > 0, 5.0).otherwise(0.0))).drop("_w", "_l")


def chrono_split(rows: DataFrame, by: Iterable[str], share: float = 0.7, order: Iterable[str] = ("ts", "symbol")) -> DataFrame:
    """The first ``share`` of each group by time is in sample."""
    by = list(by)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("in_sample", place <= F.floor(F.count(F.lit(1)).over(Window.partitionBy(*by)) * share))


def percentile_labels(bars: DataFrame, share: float = 0.1) -> DataFrame:
    """Per symbol the top and bottom share of the bars' own returns: ``rise``, ``drop`` or ``none``."""
    rows = bars.withColumn("bar_return", F.col("close") / F.col("open") - 1)
    cuts = rows.groupBy("symbol").agg(F.percentile("bar_return", F.lit(share)).alias("_lo"), F.percentile("bar_return", F.lit(1 - share)).alias("_hi"))
    kind = F.when(F.col("bar_return") >= F.col("_hi"), "rise").when(F.col("bar_return") <= F.col("_lo"), "drop").otherwise("none")
    return rows.join(cuts, "symbol").withColumn("label", kind).drop("_lo", "_hi")


def position_segments(bars: DataFrame, fast: int = 10, slow: int = 30) -> DataFrame:
    """Long and short segments between crosses of two averages: entry, exit, bars, signed return."""
    from .features import sma

    rows = bars.withColumn("side", F.when(sma(fast) > sma(slow), 1).when(sma(fast) < sma(slow), -1)).where("side is not null")
    turn = F.coalesce((F.col("side") != lag("side")).cast("int"), F.lit(1))
    rows = rows.withColumn("_t", turn).withColumn("segment", F.sum("_t").over(by_symbol()))
    out = rows.groupBy("symbol", "segment").agg(
        F.first("side").alias("side"), F.min("ts").alias("entry_ts"), F.max("ts").alias("exit_ts"), F.min_by("close", "ts").alias("entry"), F.max_by("close", "ts").alias("exit"), F.count(F.lit(1)).alias("n_bars"),
    )
    return out.withColumn("ret", F.col("side") * (F.col("exit") / F.col("entry") - 1) * 100)
