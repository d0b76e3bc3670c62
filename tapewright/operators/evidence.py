"""Evidence for signals: draws without a signal, metrics by slice and rule, hypotheses, retraining."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import by_symbol
from .outcomes import tstat_p

#: What a trade costs, in percent (fixed value).
SLIPPAGE = 0.05


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation of two columns over their common rows; null where one of them does not vary."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def drawn_rows(rows: DataFrame, size: DataFrame, draws: int, key: Iterable[str] = ("symbol", "ts")) -> DataFrame:
    """For each draw ``k`` rows of all (``size`` is one row ``k``), those whose hashes come first.

    Rows are counted by the first four digits of their hash. Whole digits below
    the place where ``k`` falls are taken as they are, and only the rows of that
    one digit are ranked, so that no task orders a whole draw. Every row meets
    every draw: ``draws`` is a small parameter.
    """
    rows = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    rows = rows.withColumn("_h", F.md5(F.concat_ws("|", "draw", *[F.col(c).cast("string") for c in key]))).withColumn("_d", F.substring("_h", 1, 4))
    over = Window.partitionBy("draw").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("draw", "_d").agg(F.count(F.lit(1)).alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(over), F.lit(0)))
    # One row, joined by a constant.
    counts = counts.withColumn("_one", F.lit(1)).join(size.select("k", F.lit(1).alias("_one")), "_one").where(F.col("_before") < F.col("k"))
    counts = counts.select("draw", "_d", "_before", (F.col("_before") + F.col("_m") <= F.col("k")).alias("_whole"), "k")
    found = rows.join(counts, ["draw", "_d"])
    rank = F.row_number().over(Window.partitionBy("draw", "_d").orderBy("_h", *key))
    part = found.where(~F.col("_whole")).withColumn("_r", rank).where(F.col("_before") + F.col("_r") <= F.col("k")).drop("_r")
    return found.where("_whole").unionByName(part).drop("_h", "_d", "_before", "_whole", "k")


def permutation_test(rows: DataFrame, signal: str, ret: str, shuffles: int = 50, value: str = "hit") -> DataFrame:
    """A signal's hit rate (``value='hit'``) or mean return (``'mean'``) against draws of as many bars.

    One row ``k, observed, null_mean, null_std, null_p95, p_value, passed``; the p
    value is the share of draws that reach what was observed.
    """
    number = (F.col(ret) > 0).cast("double") if value == "hit" else F.col(ret)
    known = rows.where(F.col(ret).isNotNull()).select("symbol", "ts", F.coalesce(F.col(signal), F.lit(False)).alias("on"), number.alias("y"))
    size = known.agg(F.count_if("on").alias("k"), F.avg(F.when(F.col("on"), F.col("y"))).alias("observed"))
    null = drawn_rows(known.select("symbol", "ts", "y"), size, shuffles).groupBy("draw").agg(F.avg("y").alias("rate"))
    both = null.withColumn("_one", F.lit(1)).join(size.withColumn("_one", F.lit(1)), "_one")
    # As many rows as draws.
    return both.groupBy("k", "observed").agg(
        F.avg("rate").alias("null_mean"), F.stddev_samp("rate").alias("null_std"), F.percentile("rate", F.lit(0.95)).alias("null_p95"),
        F.avg((F.round("rate", 12) >= F.round("observed", 12)).cast("double")).alias("p_value"),
    ).withColumn("passed", F.col("observed") > F.col("null_p95"))


def label_shuffle_test(rows: DataFrame, score: str, threshold: float, ret: str, shuffles: int = 50) -> DataFrame:
    """Mean return of the rows whose score reaches a threshold against a shuffled score."""
    return permutation_test(rows.withColumn("_on", F.col(score) >= threshold), "_on", ret, shuffles, "mean")


def exact_binomial_p(n: Column, k: Column) -> Column:
    """P of ``k`` or more hits in ``n`` fair draws, term by term from logarithms; 1 for no hits."""
    choose = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + F.log((n - k + i) / i))
    first = F.exp(choose - n * math.log(2))
    later = F.when(k < n, F.sequence(k.cast("int") + 1, n.cast("int"))).otherwise(F.array().cast("array<int>"))
    run = F.aggregate(later, F.struct(first.alias("term"), first.alias("sum")), lambda a, i: F.struct((a["term"] * (n - i + 1) / i).alias("term"), (a["sum"] + a["term"] * (n - i + 1) / i).alias("sum")))
    return F.least(run["sum"], F.lit(1.0))


def fisher_combine(stats: DataFrame, by: Iterable[str], p: str = "p_value") -> DataFrame:
    """Weighted hit rate and mean over groups, and Fisher's combined p: ``-2 sum ln p`` on ``2 m`` degrees of freedom."""
    by, floor = list(by), 1e-12
    out = stats.groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("hit_rate")) / F.sum("n")).alias("hit_rate"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        (-2 * F.sum(F.log(F.greatest(F.col(p), F.lit(floor))))).alias("chi2"),
    )
    half = F.col("chi2") / 2
    terms = F.aggregate(F.sequence(F.lit(1), F.col("groups").cast("int")), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")), lambda a, i: F.struct((a["t"] * half / i).alias("t"), (a["s"] + a["t"]).alias("s")))
    return out.withColumn("combined_p", F.exp(-half) * terms["s"])


def _net(ret: str) -> Column:
    return F.col(ret) - SLIPPAGE


def net_metrics(ret: str, rule: Column | None = None, suffix: str = "") -> list[Column]:
    """Aggregates of returns less slippage: number, win rate, expectancy, sums of wins and losses."""
    when = (lambda c: F.when(rule, c)) if rule is not None else (lambda c: c)
    r = when(_net(ret))
    return [
        F.count(r).alias(f"n{suffix}"), F.avg((r > 0).cast("double")).alias(f"wr{suffix}"), F.avg(r).alias(f"exp{suffix}"),
        F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias(f"_w{suffix}"), F.coalesce(-F.sum(F.when(r <= 0, r)), F.lit(0.0)).alias(f"_l{suffix}"),
    ]


def _factor(suffix: str = "") -> Column:
    w, x = F.col(f"_w{suffix}"), F.col(f"_l{suffix}")
    return F.when(F.col(f"n{suffix}") == 0, 0.0).when(x == 0, F.when(w > 0, 5.0).otherwise(1.0)).otherwise(F.least(F.lit(5.0), w / F.nullif(x, F.lit(0.0))))


def _settled(df: DataFrame, *suffixes: str) -> DataFrame:
    """Profit factors in place of the sums, and zeros for empty sides."""
    for s in suffixes:
        df = df.withColumns({f"pf{s}": _factor(s), f"wr{s}": F.coalesce(f"wr{s}", F.lit(0.0)), f"exp{s}": F.coalesce(f"exp{s}", F.lit(0.0))}).drop(f"_w{s}", f"_l{s}")
    return df


def slice_metrics(trades: DataFrame, slices: dict[str, Column], ret: str = "ret") -> DataFrame:
    """Metrics of every value of every slice, from one pass over the trades in long form."""
    pairs = F.array(*[F.struct(F.lit(n).alias("slice"), c.cast("string").alias("value")) for n, c in slices.items()])
    long = trades.select(ret, F.inline(pairs)).where("value is not null")
    return _settled(long.groupBy("slice", "value").agg(*net_metrics(ret)), "")


def setup_status(trades: DataFrame, by: str, slices: dict[str, Column], ret: str = "ret") -> DataFrame:
    """Per set-up the metrics in and out of sample, its status, and its best context of ten trades or more."""
    inside = F.col("in_sample")
    out = _settled(trades.groupBy(by).agg(*net_metrics(ret, inside, "_is"), *net_metrics(ret, ~inside, "_oos")), "_is", "_oos")
    c = F.col
    is_ok = (c("wr_is") >= 0.50) & (c("exp_is") >= 0.10) & (c("pf_is") >= 1.20)
    oos_ok = (c("n_oos") >= 10) & (c("wr_oos") >= 0.47) & (c("exp_oos") >= 0.05) & (c("pf_oos") >= 1.10)
    bad = (c("n_oos") >= 10) & (c("exp_oos") < -0.05) & (c("pf_oos") < 0.90)
    status = F.when(c("n_is") < 30, "collecting").when(bad, "rejected").when(is_ok & oos_ok, "promoted").when(is_ok, "candidate").otherwise("collecting")
    pairs = F.array(*[F.struct(F.concat(F.lit(f"{n}="), v.cast("string")).alias("context")) for n, v in slices.items()])
    contexts = trades.select(by, ret, F.inline(pairs)).where("context is not null").groupBy(by, "context").agg(F.count(F.lit(1)).alias("m"), F.avg(_net(ret)).alias("e")).where("m >= 10")
    best = contexts.groupBy(by).agg(F.max(F.struct(F.round("e", 9).alias("e"), "context")).alias("b")).select(by, F.col("b.context").alias("best_context"), F.col("b.e").alias("best_exp"))
    return out.withColumn("status", status).join(best, by, "left")


def refine_rules(trades: DataFrame, by: str, conditions: dict[str, Column], pairs: Iterable[tuple[str, str]], ret: str = "ret") -> DataFrame:
    """Single conditions and allowed pairs as rules on each set-up: metrics, breadth, dependence on one trade, status.

    ``trades`` has ``symbol, ts, in_sample``. Each trade is exploded to the rules
    that it meets, so all rules take one pass and partial sums before the shuffle.
    """
    rows = trades.withColumns({f"_{n}": F.coalesce(c, F.lit(False)) for n, c in conditions.items()})
    rules = [F.when(F.col(f"_{n}"), F.lit(n)) for n in conditions] + [F.when(F.col(f"_{a}") & F.col(f"_{b}"), F.lit(f"{a}+{b}")) for a, b in pairs]
    found = F.filter(F.array(F.lit("all"), *rules), lambda x: x.isNotNull())
    long = rows.select(by, "symbol", F.date_trunc("week", "ts").alias("week"), "in_sample", ret, F.explode(found).alias("rule"))
    inside = F.col("in_sample")
    sums = long.groupBy(by, "rule").agg(
        *net_metrics(ret, inside, "_is"), *net_metrics(ret, ~inside, "_oos"), F.count(F.lit(1)).alias("n"), F.sum(_net(ret)).alias("_sum"), F.max(_net(ret)).alias("_max"), F.countDistinct("week").alias("weeks"),
    )
    breadth = long.groupBy(by, "rule", "symbol").agg(F.count(F.lit(1)).alias("m")).groupBy(by, "rule").agg(F.count_if(F.col("m") >= 3).alias("symbols"))
    out = _settled(sums.join(breadth, [by, "rule"]), "_is", "_oos")
    mean = F.col("_sum") / F.col("n")
    rest = (F.col("_sum") - F.col("_max")) / F.nullif(F.col("n") - 1, F.lit(0))
    drop = F.when(F.col("n") < 3, 1.0).when(mean <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), (mean - rest) / F.nullif(F.abs(mean), F.lit(0.0))))
    out = out.withColumn("sensitivity", drop)
    base = out.where("rule = 'all'").select(by, F.col("exp_is").alias("base_exp_is"), F.col("pf_oos").alias("base_pf_oos"))
    out = out.where("rule <> 'all'").join(base, by)
    c = F.col
    failed = (c("n_is") < 20) | (c("n_oos") < 5) | (c("exp_oos") <= 0) | (c("pf_oos") <= c("base_pf_oos")) | (c("symbols") < 3) | (c("weeks") < 3) | (c("sensitivity") > 0.40)
    status = F.when(failed, "rejected").when(c("exp_is") > c("base_exp_is"), "promoted").otherwise("candidate")
    return out.withColumn("status", status).drop("_sum", "_max", "n")


def resolve_pending(signals: DataFrame, bars: DataFrame, horizons: Iterable[int] = (1, 5, 10)) -> DataFrame:
    """Signals with the returns that are still missing filled in from bars that exist by now; known ones stay."""
    horizons = list(horizons)
    later = bars.select("symbol", "ts", *[((F.lead("close", h).over(by_symbol()) / F.col("close") - 1) * 100).alias(f"_f{h}") for h in horizons])
    out = signals.join(later, ["symbol", "ts"], "left").withColumns({f"ret_{h}d": F.coalesce(f"ret_{h}d", f"_f{h}") for h in horizons})
    return out.withColumn("resolved", F.col(f"ret_{max(horizons)}d").isNotNull()).drop(*[f"_f{h}" for h in horizons])


def attach_latest(rows: DataFrame, scores: DataFrame, key: str, order: str, at: str = "ts") -> DataFrame:
    """Each row with the newest score row of its key."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    best = scores.withColumn("_n", newest).where("_n = 1").drop("_n").withColumnRenamed(order, f"score_{order}")
    return rows.join(best, key, "left")


def worst_fall(rows: DataFrame, by: list[str], ret: str, block: Column, order: Iterable[str]) -> DataFrame:
    """``by, max_drawdown`` of the running sum of returns, in two levels: within blocks of time, then over the blocks."""
    rows = rows.withColumn("_block", block)
    inside = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_c", F.sum(ret).over(inside)).withColumn("_m", F.max("_c").over(inside))
    blocks = rows.groupBy(*by, "_block").agg(F.sum(ret).alias("_s"), F.max("_c").alias("_high"), F.min("_c").alias("_low"), F.max(F.col("_m") - F.col("_c")).alias("_fall"))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)))
    blocks = blocks.withColumn("_top", F.max(F.col("_before") + F.col("_high")).over(earlier))
    fall = F.greatest("_fall", F.coalesce(F.col("_top") - F.col("_before") - F.col("_low"), F.lit(0.0)))
    return blocks.groupBy(*by).agg(F.max(fall).alias("max_drawdown"))


#: Weights of the parts of a hypothesis's score (fixed values).
COMPOSITE = {"hit_rate": 0.30, "sharpe": 0.35, "rank_ic": 0.25, "sample_size": 0.10}


def hypothesis_stats(events: DataFrame, by: list[str], ret: str, horizon: int, regime: str, short: Column | None = None, least: int = 15) -> DataFrame:
    """Statistics of each hypothesis's events: mean, median, t, Sharpe, worst fall, rank IC with time, regimes, composite score.

    Returns of short hypotheses change their sign. Groups under ``least`` events are
    left out. The p value is that of the normal tail.
    """
    sign = F.when(short, -1.0).otherwise(1.0) if short is not None else F.lit(1.0)
    rows = events.withColumns({"_raw": F.col(ret), "_r": F.col(ret) * sign})
    # Mean ranks of ties, from counts of distinct values.
    for c in ("ts", "_raw"):
        counts = rows.groupBy(*by, c).agg(F.count(F.lit(1)).alias("_n"))
        place = F.sum("_n").over(Window.partitionBy(*by).orderBy(c)) - F.col("_n") + (F.col("_n") + 1) / 2
        rows = rows.join(counts.select(*by, c, place.alias(f"_rank_{c}")), [*by, c])
    hit = lambda rule: F.avg(F.when(rule, (F.col("_r") > 0).cast("double")))
    regimes = [x for name in ("bull", "bear", "range") for x in (F.count_if(F.col(regime) == name).alias(f"n_{name}"), hit(F.col(regime) == name).alias(f"hit_{name}"))]
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_r").alias("mean"), F.percentile("_r", F.lit(0.5)).alias("median"), F.stddev_samp("_r").alias("std"), F.avg((F.col("_r") > 0).cast("double")).alias("hit_rate"),
        F.countDistinct("symbol").alias("_symbols"), correlation(F.col("_rank_ts"), F.col("_rank__raw")).alias("_ic"), *regimes,
    ).where(F.col("n") >= least)
    out = out.join(worst_fall(rows, by, "_r", F.date_trunc("month", "ts"), ["ts", "symbol"]), by)
    out = out.withColumns(
        {
            "t_stat": F.when(F.col("std") > 0, F.col("mean") / (F.col("std") / F.sqrt("n"))),
            "p_value": tstat_p(F.col("n"), F.col("mean"), F.col("std")),
            "sharpe": F.when(F.col("std") > 0, F.col("mean") / F.nullif(F.col("std"), F.lit(0.0)) * math.sqrt(252 / max(horizon, 1))).otherwise(0.0),
            "rank_ic": F.when(F.col("_symbols") > 1, F.col("_ic")),
        }
    ).drop("_symbols", "_ic")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    parts = {
        "hit_rate": F.greatest(F.lit(0.0), (F.col("hit_rate") - 0.5) / 0.5), "sharpe": unit(F.col("sharpe") / 2), "rank_ic": unit(F.coalesce("rank_ic", F.lit(0.0)) / 0.1),
        "sample_size": F.least(F.lit(1.0), F.log10("n") / math.log10(200)),
    }
    return out.withColumn("composite", sum((COMPOSITE[n] * c for n, c in parts.items()), F.lit(0.0)))


def hypothesis_leaderboard(stats: DataFrame, hypotheses: DataFrame, key: str, p: float = 0.10) -> DataFrame:
    """Results with their hypotheses, p under a bound or unknown, ranked by the composite score."""
    rows = stats.where(F.col("p_value").isNull() | (F.col("p_value") < p)).join(hypotheses, key)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("composite", 9)), key, "horizon")))


def promote_hypotheses(stats: DataFrame, key: str, least: int = 20, hit: float = 0.55, p: float = 0.10, composite: float = 0.40) -> DataFrame:
    """Each hypothesis at its best horizon, whether it passes all four thresholds, and the name of its feature."""
    best = stats.groupBy(key).agg(F.max_by(F.struct("horizon", "n", "hit_rate", "p_value", "composite"), F.struct(F.round("composite", 9), -F.col("horizon"))).alias("b")).select(key, "b.*")
    passed = (F.col("n") >= least) & (F.col("hit_rate") >= hit) & F.coalesce(F.col("p_value") <= p, F.lit(False)) & (F.col("composite") >= composite)
    name = F.concat(F.lower(key), F.lit("_h"), F.col("horizon").cast("string"))
    name = F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[^\w\s]", ""), r"\s+", "_"), "_+", "_"), 1, 80)
    return best.withColumns({"promoted": passed, "feature_name": name})


#: What calls for a new model: days, correlation, features, symbols, accuracy, drag of the lower tiers, triggers needed (fixed values).
STALE_DAYS, IC_FLOOR, UNRELIABLE, NEW_SYMBOLS, ACCURACY_DROP, TIER_DRAG, NEEDED = 30, 0.005, 3, 100, 0.02, 0.03, 3


def retrain_triggers(checks: DataFrame) -> DataFrame:
    """From one row of measures the seven triggers in long form, and whether enough of them call for a new model.

    ``checks``: ``days_since, ic_20d, newly_unreliable, regime_flipped (0/1),
    new_symbols, accuracy_drop, tier_drag``; a missing measure does not trigger.
    """
    rules = {
        "stale": ("days_since", F.col("days_since") > STALE_DAYS), "ic_floor": ("ic_20d", F.col("ic_20d") < IC_FLOOR), "unreliable_features": ("newly_unreliable", F.col("newly_unreliable") >= UNRELIABLE),
        "regime_flip": ("regime_flipped", F.col("regime_flipped") > 0), "new_symbols": ("new_symbols", F.col("new_symbols") >= NEW_SYMBOLS), "accuracy_drop": ("accuracy_drop", F.col("accuracy_drop") > ACCURACY_DROP),
        "tier_drag": ("tier_drag", F.col("tier_drag") > TIER_DRAG),
    }
    fired = {n: F.coalesce(rule, F.lit(False)) for n, (_, rule) in rules.items()}
    count = sum((f.cast("int") for f in fired.values()), F.lit(0))
    items = F.array(*[F.struct(F.lit(n).alias("trigger"), F.col(c).cast("double").alias("value"), fired[n].alias("fired")) for n, (c, _) in rules.items()])
    return checks.withColumn("triggers", count).select("triggers", (F.col("triggers") >= NEEDED).alias("retrain"), F.inline(items))


#: Weights of the four groups of the independent alignment (fixed values).
GROUPS = {"ml": 0.40, "feature_ic": 0.20, "regime": 0.20, "momentum": 0.20}


def independent_alignment(rows: DataFrame, margin: float = 1.15) -> DataFrame:
    """Four groups vote: three components, and patterns or probabilities that back the three's direction.

    Adds ``core_direction, group_direction, groups_aligned, group_level``.
    """
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    core = ("ml", "feature_ic", "regime")
    side = lambda s: sum((F.when(F.col(f"{c}_dir") == s, GROUPS[c] * known(f"{c}_str")).otherwise(0.0) for c in core), F.lit(0.0))
    dominant = lambda a, b: F.when(F.col(a) > margin * F.col(b), 1).when(F.col(b) > margin * F.col(a), -1).otherwise(0)
    rows = rows.withColumns({"_a": side(1), "_b": side(-1)}).withColumn("core_direction", dominant("_a", "_b"))
    backed = (F.col("core_direction") != 0) & F.coalesce((F.col("pattern_dir") == F.col("core_direction")) | (F.col("probability_dir") == F.col("core_direction")), F.lit(False))
    rows = rows.withColumn("_mom", F.when(backed, F.col("core_direction")).otherwise(0))
    rows = rows.withColumns({"_a": F.col("_a") + F.when(F.col("_mom") == 1, GROUPS["momentum"]).otherwise(0.0), "_b": F.col("_b") + F.when(F.col("_mom") == -1, GROUPS["momentum"]).otherwise(0.0)})
    rows = rows.withColumn("group_direction", dominant("_a", "_b"))
    votes = [F.col(f"{c}_dir") for c in core] + [F.col("_mom")]
    aligned = F.when(F.col("group_direction") == 0, 0).otherwise(sum((F.when(v == F.col("group_direction"), 1).otherwise(0) for v in votes), F.lit(0)))
    groups = 1 + sum((F.when(F.col(f"{c}_dir").isNotNull(), 1).otherwise(0) for c in core), F.lit(0))
    share = F.col("groups_aligned") / groups
    rows = rows.withColumn("groups_aligned", aligned)
    level = F.when(F.col("group_direction") == 0, "NEUTRAL").when(share >= 0.90, "VERY_HIGH").when(share >= 0.65, "HIGH").when(share >= 0.40, "MODERATE").otherwise("LOW")
    return rows.withColumn("group_level", level).drop("_a", "_b", "_mom")


def component_comparison(rows: DataFrame, components: Iterable[str], ret: str, periods: float = 252 / 5) -> DataFrame:
    """Each component's calls alone: number, hit rate, expectancy, Sharpe and correlation with the return."""
    pairs = F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"{c}_dir").alias("side"), (F.col(f"{c}_dir") * F.col(f"{c}_str")).alias("signed")) for c in components])
    long = rows.where(F.col(ret).isNotNull()).select(ret, F.inline(pairs)).where("side <> 0").withColumn("r", F.col("side") * F.col(ret))
    out = long.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"), F.avg("r").alias("expectancy"), F.stddev_samp("r").alias("_s"), correlation(F.col("signed"), F.col(ret)).alias("ic"))
    return out.withColumn("sharpe", F.when(F.col("_s") > 0, F.col("expectancy") / F.nullif(F.col("_s"), F.lit(0.0)) * math.sqrt(periods))).drop("_s")


def evidence_breakdown(rows: DataFrame, top: Column, keys: dict[str, Column], ret: str) -> DataFrame:
    """Within the rows of the top level: outcomes by each key."""
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), c.cast("string").alias("value")) for n, c in keys.items()])
    long = rows.where(top & F.col(ret).isNotNull()).select(ret, F.inline(pairs))
    return long.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"), F.avg(ret).alias("mean"))


def followups(bars: DataFrame, base: str, modifiers: dict[str, Column], ret: str) -> DataFrame:
    """A base condition alone and with each modifier: cases, outcome, and whether there are enough of them."""
    on = F.coalesce(F.col(base), F.lit(False))
    items = F.array(F.struct(F.lit("none").alias("modifier"), on.alias("on")), *[F.struct(F.lit(n).alias("modifier"), (on & F.coalesce(c, F.lit(False))).alias("on")) for n, c in modifiers.items()])
    long = bars.select("symbol", ret, F.inline(items)).where("on")
    out = long.groupBy("symbol", "modifier").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"), F.avg(ret).alias("mean"))
    return out.withColumn("status", F.when(F.col("n") < 5, "insufficient").when(F.col("n") < 30, "candidate").otherwise("sufficient"))
