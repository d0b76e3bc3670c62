"""Suites of conditions, significance, trades with exits, slices, calibration."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import ahead, lead
from .conditions import masks
from .outcomes import forward_returns, normal_tail


def run_suite(bars: DataFrame, specs: dict[str, tuple[str, dict]], horizons: Iterable[int] = (1, 5, 10), least: int = 30) -> DataFrame:
    """Every condition on every symbol and over all, from one pass: grouping sets over (condition, horizon) and with the symbol."""
    rows = forward_returns(masks(bars, specs), horizons)
    fired = F.array(*[F.struct(F.lit(n).alias("condition"), F.col(n).alias("on")) for n in specs])
    later = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}d").alias("ret")) for h in horizons])
    long = rows.select("symbol", F.inline(fired), later.alias("_l")).where("on").select("symbol", "condition", F.inline("_l")).where("ret is not null")
    sets = long.groupingSets([[F.col("condition"), F.col("horizon"), F.col("symbol")], [F.col("condition"), F.col("horizon")]], F.col("condition"), F.col("horizon"), F.col("symbol"))
    out = sets.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("ret") > 0).cast("int")).alias("hit_rate"), F.avg("ret").alias("mean"), F.grouping("symbol").alias("_g"))
    return out.where(F.col("n") >= least).withColumn("symbol", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("symbol"))).drop("_g")


def param_search(bars: DataFrame, condition: str, grid: list[dict], horizon: int = 5, least: int = 5) -> DataFrame:
    """A grid of parameters as rows of one plan, ranked by ``mean * hit rate`` (0 without an edge)."""
    specs = {f"_p{i}": (condition, p) for i, p in enumerate(grid)}
    rows = forward_returns(masks(bars, specs), [horizon]).where(F.col(f"fwd_{horizon}d").isNotNull())
    labels = [",".join(f"{k}={v}" for k, v in sorted(p.items())) for p in grid]
    fired = F.array(*[F.struct(F.lit(label).alias("params"), F.col(n).alias("on")) for n, label in zip(specs, labels, strict=True)])
    long = rows.select(F.col(f"fwd_{horizon}d").alias("ret"), F.inline(fired)).where("on")
    out = long.groupBy("params").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("ret") > 0).cast("int")).alias("hit_rate"), F.avg("ret").alias("mean"))
    return out.withColumn("edge", F.when((F.col("mean") <= 0) | (F.col("n") < least), 0.0).otherwise(F.col("mean") * F.col("hit_rate")))


def promotion(stats: DataFrame, least: int = 30, hit: float = 0.55, p: float = 0.05, robust: Column | None = None) -> DataFrame:
    """Whether a signal passes, why not, and ``mean * hit * 100 * log2(n + 1)`` up to 100, times 0.7 where ``robust`` is false."""
    reasons = {"few_events": F.col("n") < least, "low_hit_rate": F.col("hit_rate") < hit, "not_significant": F.coalesce(F.col("p_value") >= p, F.lit(True)), "no_edge": F.col("mean") <= 0}
    why = F.concat_ws("|", *[F.when(c, F.lit(n)) for n, c in reasons.items()])
    score = F.least(F.greatest(F.col("mean") * F.col("hit_rate") * 100 * F.log2(F.col("n") + 1), F.lit(0.0)), F.lit(100.0))
    if robust is not None:
        score = score * F.when(F.coalesce(robust, F.lit(False)), 1.0).otherwise(0.7)
    return stats.withColumns({"reasons": why, "promotion_score": score}).withColumn("passed", F.col("reasons") == "")


def bootstrap_p(groups: DataFrame, universe_rate: Column) -> DataFrame:
    """P of at least so many hits in draws with replacement from the universe, in closed form by the normal tail."""
    hits = F.col("hit_rate") * F.col("n")
    z = (hits - 0.5 - F.col("n") * universe_rate) / F.sqrt(F.col("n") * universe_rate * (1 - universe_rate))
    return groups.withColumn("p_value", F.when(z >= 0, normal_tail(z) / 2).otherwise(1 - normal_tail(z) / 2))


def reconstruct_trades(bars: DataFrame, signals: DataFrame, atr: str = "atr_14", hold: int = 20) -> DataFrame:
    """Entries at the close of a signal with exits after 5, 10 and 20 bars, excursions, stop at 1.5 ATR and targets at 1, 2 and 3."""
    rows = bars.withColumns({f"_x{h}": lead("close", h) for h in (5, 10, 20)})
    over = ahead(1, hold)
    rows = rows.withColumns({"_hi": F.max("high").over(over), "_lo": F.min("low").over(over)})
    rows = rows.join(signals.select("symbol", "ts", "direction"), ["symbol", "ts"]).where(F.col("direction") != 0)
    d, c = F.col("direction"), F.col("close")
    best = F.greatest(F.when(d > 0, F.col("_hi") / c - 1).otherwise(1 - F.col("_lo") / c), F.lit(0.0)) * 100
    worst = F.greatest(F.when(d > 0, 1 - F.col("_lo") / c).otherwise(F.col("_hi") / c - 1), F.lit(0.0)) * 100
    unit = F.col(atr) / c * 100
    out = rows.withColumns({f"ret_{h}": d * (F.col(f"_x{h}") / c - 1) * 100 for h in (5, 10, 20)} | {"mfe": best, "mae": worst, "atr_pct": unit})
    out = out.withColumns({"stopped": F.col("mae") >= 1.5 * unit, "t1": F.col("mfe") >= unit, "t2": F.col("mfe") >= 2 * unit, "t3": F.col("mfe") >= 3 * unit})
    return out.where(F.col("_x20").isNotNull()).select("symbol", "ts", "direction", "ret_5", "ret_10", "ret_20", "mfe", "mae", "atr_pct", "stopped", "t1", "t2", "t3")


def exit_rules(trades: DataFrame, conviction: Column | None = None) -> DataFrame:
    """What each of ten exit rules would have made of every trade, in long form.

    Targets are one, two and three ranges (``atr_pct``), the stop is 1.5. Rules with
    targets hold five bars where no range is known. ``conviction`` says which trades
    ``hold_20_if_high`` holds for 20 bars; without it there are none.
    """
    u = F.greatest(F.coalesce("atr_pct", F.lit(0.0)), F.lit(0.0))
    known, r5, mfe, mae = u > 0, F.col("ret_5"), F.coalesce("mfe", F.lit(0.0)), F.coalesce("mae", F.lit(0.0))
    t1, t2, t3, stopped = (known & F.col(c) for c in ("t1", "t2", "t3", "stopped"))
    stop = -1.5 * u
    runner = F.when(F.col("t2"), 2 * u).otherwise(F.greatest(u, r5))
    first = F.when(t1, u).when(stopped, stop).otherwise(r5)
    rules = {
        "hold_5": r5,
        "hold_10": F.col("ret_10"),
        "hold_20": F.col("ret_20"),
        "t1_only": first,
        "t1_and_runner": F.when(t1, 0.5 * u + 0.5 * runner).when(stopped, stop).otherwise(r5),
        "ladder": F.when(t3, (u + 2 * u + 3 * u) / 3).when(t2, (u + 2 * u + r5) / 3).when(t1, u / 3 + 2 * r5 / 3).when(stopped, stop).otherwise(r5),
        "break_even": F.when(t1, F.greatest(F.lit(0.0), r5)).when(stopped, stop).otherwise(r5),
        "trail": F.when(known & (mfe >= 2 * u), F.greatest(r5, u)).when(known & (mfe >= u), F.greatest(r5, F.lit(0.0))).otherwise(r5),
        "hold_20_if_high": F.when(conviction if conviction is not None else F.lit(False), F.col("ret_20")).otherwise(r5),
        "tight_stop": F.when(known & (mae >= 0.75 * u) & ~F.col("t1"), -0.75 * u).otherwise(first),
    }
    return trades.select("symbol", "ts", F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("ret")) for n, c in rules.items()]))).where("ret is not null")


def failure_modes(trades: DataFrame) -> DataFrame:
    """Why trades fail: stopped before the first target, target then reversal, flat, tight range."""
    rules = {
        "stop_before_t1": F.col("stopped") & ~F.col("t1"),
        "t1_then_loss": F.col("t1") & (F.col("ret_20") < 0),
        "flat": F.abs("ret_5") < 0.5,
        "tight_range": F.col("atr_pct") < 5,
    }
    long = trades.select("ret_5", F.inline(F.array(*[F.struct(F.lit(n).alias("mode"), c.alias("on")) for n, c in rules.items()])))
    out = long.groupBy("mode").agg(F.count_if("on").alias("n"), (100.0 * F.count_if("on") / F.count(F.lit(1))).alias("share_pct"), F.avg(F.when(F.col("on"), F.col("ret_5"))).alias("mean_ret"))
    return out


def slippage_sweep(trades: DataFrame, points: Iterable[int] = (0, 10, 25, 50), ret: str = "ret_5") -> DataFrame:
    """Expectancy and win rate after twice the slippage of each side."""
    cost = F.array(*[F.lit(b) for b in points])
    rows = trades.select(F.col(ret).alias("r"), F.explode(cost).alias("bps"))
    net = F.col("r") - 2 * F.col("bps") / 100
    return rows.groupBy("bps").agg(F.count(F.lit(1)).alias("n"), F.avg(net).alias("expectancy"), F.avg((net > 0).cast("int")).alias("win_rate"))


def daily_topn(trades: DataFrame, score: str, sizes: Iterable[int] = (1, 3), ret: str = "ret_5") -> DataFrame:
    """The strongest few per date, for several sizes, from one ranking."""
    ranked = trades.withColumn("_k", F.row_number().over(Window.partitionBy("ts").orderBy(F.desc(score), "symbol")))
    rows = ranked.where(F.col("_k") <= max(sizes)).select("_k", F.col(ret).alias("r"), F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")).where("_k <= size")
    return rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("expectancy"), F.avg((F.col("r") > 0).cast("int")).alias("win_rate"))


def pairwise_slices(rows: DataFrame, axes: list[str], ret: str, least: int = 10) -> DataFrame:
    """Every axis and every pair of axes by grouping sets: size, hit rate, expectancy."""
    singles = [[a] for a in axes]
    pairs = [list(p) for p in combinations(axes, 2)]
    out = rows.where(F.col(ret).isNotNull()).groupingSets([[F.col(a) for a in s] for s in singles + pairs], *[F.col(a) for a in axes])
    out = out.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(ret) > 0).cast("int")).alias("hit_rate"), F.avg(ret).alias("expectancy"), *[F.grouping(a).alias(f"_{a}") for a in axes])
    label = F.concat_ws("|", *[F.when(F.col(f"_{a}") == 0, F.concat(F.lit(f"{a}="), F.coalesce(F.col(a).cast("string"), F.lit("unk")))) for a in axes])
    return out.where(F.col("n") >= least).select(label.alias("slice"), "n", "hit_rate", "expectancy")


def attribution(rows: DataFrame, features: list[str], win: Column) -> DataFrame:
    """Winners against losers by feature: sizes, means and Cohen's d."""
    long = rows.select(win.alias("win"), F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features]))).where("x is not null and win is not null")
    side = lambda f, w, name: f(F.when(F.col("win") == w, F.col("x"))).alias(name)
    out = long.groupBy("feature").agg(
        side(F.count, True, "n_win"), side(F.count, False, "n_loss"), side(F.avg, True, "mean_win"), side(F.avg, False, "mean_loss"), side(F.var_samp, True, "v1"), side(F.var_samp, False, "v2"),
    )
    pooled = F.sqrt(((F.col("n_win") - 1) * F.col("v1") + (F.col("n_loss") - 1) * F.col("v2")) / (F.col("n_win") + F.col("n_loss") - 2))
    return out.withColumn("cohens_d", F.when(pooled > 0, (F.col("mean_win") - F.col("mean_loss")) / pooled)).drop("v1", "v2")


def combo_scores(trades: DataFrame, key: str, as_of: str, days: int = 60, ret: str = "ret") -> DataFrame:
    """Per combination over ``[as_of - days, as_of)``: size, profit factor up to 5, expectancy, scaled score."""
    end = F.lit(as_of).cast("date")
    rows = trades.where((F.col("ts") >= F.date_sub(end, days)) & (F.col("ts") < end))
    out = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(ret).alias("expectancy"), F.avg((F.col(ret) > 0).cast("int")).alias("win_rate"),
        F.coalesce(F.sum(F.when(F.col(ret) > 0, F.col(ret))), F.lit(0.0)).alias("_w"), F.coalesce(-F.sum(F.when(F.col(ret) < 0, F.col(ret))), F.lit(0.0)).alias("_l"),
    )
    out = out.withColumn("profit_factor", F.when(F.col("_l") > 0, F.least(F.col("_w") / F.col("_l"), F.lit(5.0))).when(F.col("_w") > 0, 5.0).otherwise(0.0))
    out = out.withColumn("raw", F.col("profit_factor") * F.col("expectancy") * F.log2(F.col("n") + 1))
    top = out.agg(F.max("raw").alias("_top"))
    return out.join(F.broadcast(top)).withColumn("meta_score", F.when(F.col("_top") > 0, F.greatest(F.col("raw") / F.col("_top") * 100, F.lit(0.0))).otherwise(0.0)).drop("_w", "_l", "_top", "raw")


def confidence_buckets(rows: DataFrame, keys: list[str], hit: str, pseudo: float = 50.0) -> DataFrame:
    """Accuracy by key, smoothed towards the whole by pseudo-observations, and the multiplier from 0.5 to 1.5."""
    base = rows.agg(F.avg(hit).alias("_base"))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("_h")).join(F.broadcast(base))
    smooth = (F.col("_h") + pseudo * F.col("_base")) / (F.col("n") + pseudo)
    return out.withColumns({"accuracy": smooth, "multiplier": F.least(F.greatest(smooth / F.col("_base"), F.lit(0.5)), F.lit(1.5))}).drop("_h", "_base")


