"""Weighted vote of signal components into a direction and a score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the components (fixed values); risk only takes away.
WEIGHTS = {"ml": 0.30, "pattern": 0.20, "probability": 0.20, "feature_ic": 0.10, "regime": 0.15}
MARGIN = 1.15


def _known(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def component_ml(probability: Column, rank: Column) -> tuple[Column, Column]:
    """Direction at 0.55 and 0.45; strength from the distances of probability and rank from the middle."""
    direction = F.when(probability >= 0.55, 1).when(probability <= 0.45, -1).otherwise(0)
    strength = 0.6 * F.abs(probability - 0.5) * 2 + 0.4 * F.abs(rank - 0.5) * 2
    return direction, F.when(direction != 0, strength).otherwise(0.0)


#: How well a direction suits a market (fixed values); other pairs have 0.85, no regime at all 0.90.
FITNESS = {
    ("bull", 1): 1.00, ("bull", -1): 0.72, ("bull", 0): 0.85, ("bear", -1): 1.00, ("bear", 1): 0.72, ("bear", 0): 0.85,
    ("range", 1): 0.88, ("range", -1): 0.88, ("range", 0): 0.80,
}


def component_regime(trend: Column, above_200: Column) -> tuple[Column, Column, Column]:
    """Market regime, direction and strength from the market's trend (+1, 0, -1) and its side of the 200-bar average.

    Without a trend the side decides; without both the component is missing (null).
    """
    regime = F.when(trend > 0, "bull").when(trend < 0, "bear").when(trend == 0, "range").when(above_200 > 0.5, "bull").when(above_200 <= 0.5, "bear")
    above = F.coalesce(above_200 > 0.5, F.lit(False))
    direction = F.when(regime.isNull(), None).when((regime == "bull") & above, 1).when((regime == "bear") & ~above, -1).otherwise(0)
    return regime, direction, F.when(direction != 0, 0.7).when(direction == 0, 0.3)


def direction_fitness(regime: Column, direction: Column) -> Column:
    out = F.when(regime.isNull(), 0.90)
    for (name, side), value in FITNESS.items():
        out = out.when((regime == name) & (direction == side), value)
    return out.otherwise(0.85)


def component_risk(quality: Column, turnover: Column, drawdown: Column, atr_pct: Column) -> Column:
    """Penalty from 0 to 25 for low data quality, thin turnover, an expected drawdown and extreme ranges; what is missing costs nothing."""
    low = F.when(quality < 0.70, 10.0).when(quality < 0.80, 4.0).otherwise(0.0)
    thin = F.when(turnover < 1_000_000, 10.0).when(turnover < 5_000_000, 4.0).otherwise(0.0)
    deep = F.when(drawdown < -0.05, 5.0).when(drawdown < -0.02, 2.0).otherwise(0.0)
    wild = F.when(atr_pct > 0.06, 3.0).otherwise(0.0)
    return F.least(low + thin + deep + wild, F.lit(25.0))


def majority(bull: Column, bear: Column, known: Column) -> tuple[Column, Column]:
    """Direction of the side with 60 % of the weight or more, and the lead as strength; null where nothing is known."""
    share = bull / F.nullif(bull + bear, F.lit(0.0))
    direction = F.when(share >= 0.60, 1).when(1 - share >= 0.60, -1).otherwise(0)
    return F.when(known & (bull + bear > 0), direction), F.when(known & (bull + bear > 0), F.abs(2 * share - 1))


def component_pattern(rows: DataFrame, triggers: list[str], stats: DataFrame, least: int = 20, hit: float = 0.55) -> DataFrame:
    """Add ``pattern_dir, pattern_str`` from the validated patterns that a row triggers.

    ``stats`` has ``pattern, n, hit_rate, avg_return``, one row a trigger; patterns
    with fewer than ``least`` cases are left out. Those with a hit rate of ``hit``
    count for the side of their mean return. Null where no pattern is active.
    """
    valid = stats.where(F.col("n") >= least).groupBy(F.lit(1).alias("_one")).agg(F.map_from_entries(F.collect_list(F.struct("pattern", F.struct("hit_rate", "avg_return")))).alias("_stats"))
    fired = F.filter(F.array(*[F.when(F.col(t), F.lit(t)) for t in triggers]), lambda x: x.isNotNull())
    rows = rows.withColumns({"_one": F.lit(1), "_fired": fired}).join(valid, "_one", "left")
    rows = rows.withColumn("_active", F.filter(F.transform("_fired", lambda t: F.col("_stats")[t]), lambda x: x.isNotNull()))
    good = lambda side: F.filter("_active", lambda x: (x["hit_rate"] >= hit) & (side * x["avg_return"] > 0))
    rows = rows.withColumns({"_bull": F.size(good(1)), "_bear": F.size(good(-1)), "_rates": F.transform(F.concat(good(1), good(-1)), lambda x: x["hit_rate"])})
    mean = F.when(F.size("_rates") > 0, F.aggregate("_rates", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("_rates"), F.lit(0))).otherwise(0.5)
    active = F.size("_active")
    direction = F.signum(F.col("_bull") - F.col("_bear")).cast("int")
    strength = F.greatest(F.least(F.greatest("_bull", "_bear") / F.nullif(active, F.lit(0)) * (mean - 0.5) * 4.0, F.lit(1.0)), F.lit(0.0))
    out = {"pattern_dir": F.when(active > 0, direction), "pattern_str": F.when(active > 0, F.when(direction != 0, strength).otherwise(0.0))}
    return rows.withColumns(out).drop("_one", "_stats", "_fired", "_active", "_bull", "_bear", "_rates")


def component_probability(rows: DataFrame, fired: DataFrame, promoted: DataFrame, least: int = 30, hit: float = 0.55, signals: int = 2) -> DataFrame:
    """Add ``probability_dir, probability_str`` from the promoted signals that are active.

    ``fired`` has ``symbol, ts, signal``, ``promoted`` has ``signal, n, hit_rate,
    avg_return``. A signal weighs ``(hit - 0.5) min(1, n / 200)`` for the side of its
    mean return; 60 % of the weight make a direction. Null under ``signals`` active ones.
    """
    weight = F.abs((F.col("hit_rate") - 0.5) * F.least(F.col("n") / 200, F.lit(1.0)))
    good = promoted.where((F.col("n") >= least) & (F.col("hit_rate") >= hit)).select("signal", weight.alias("w"), (F.coalesce("avg_return", F.lit(0.0)) > 0).alias("up"))
    side = lambda up: F.sum(F.when(F.col("up") == up, F.col("w")).otherwise(0.0))
    sums = fired.select("symbol", "ts", "signal").join(good, "signal").groupBy("symbol", "ts").agg(side(True).alias("_bull"), side(False).alias("_bear"), F.count(F.lit(1)).alias("_n"))
    out = rows.join(sums, ["symbol", "ts"], "left")
    direction, strength = majority(F.col("_bull"), F.col("_bear"), F.col("_n") >= signals)
    return out.withColumns({"probability_dir": direction, "probability_str": strength}).drop("_bull", "_bear", "_n")


def component_feature_ic(rows: DataFrame, features: list[str], ics: DataFrame, regime: str = "regime", floor: float = 0.008, least: int = 5) -> DataFrame:
    """Add ``feature_ic_dir, feature_ic_str``: features whose IC in the row's regime speaks for a side.

    ``ics`` has ``regime, feature, mean_ic, sign_stability``. A feature counts with
    ``|IC|`` times its stability for the side of its value's sign, reversed for a
    negative IC. Null under ``least`` known features.
    """
    table = ics.where(F.abs("mean_ic") >= floor).groupBy(F.col("regime").alias("_regime"))
    table = table.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean_ic", F.coalesce("sign_stability", F.lit(0.5)).alias("s"))))).alias("_ics"))
    out = rows.join(table, F.col(regime) == F.col("_regime"), "left")
    known = {f: F.col("_ics")[f].isNotNull() & F.col(f).isNotNull() for f in features}
    weight = {f: F.abs(F.col("_ics")[f]["mean_ic"]) * F.col("_ics")[f]["s"] for f in features}
    up = {f: (F.col("_ics")[f]["mean_ic"] > 0) == (F.col(f) > 0) for f in features}
    total = lambda side: reduce(lambda a, b: a + b, [F.when(known[f] & (up[f] == side), weight[f]).otherwise(0.0) for f in features])
    count = reduce(lambda a, b: a + b, [F.when(known[f], 1).otherwise(0) for f in features])
    out = out.withColumns({"_bull": total(True), "_bear": total(False), "_n": count})
    direction, strength = majority(F.col("_bull"), F.col("_bear"), F.col("_n") >= least)
    return out.withColumns({"feature_ic_dir": direction, "feature_ic_str": strength}).drop("_regime", "_ics", "_bull", "_bear", "_n")


def alignment(rows: DataFrame, components: list[str]) -> DataFrame:
    """From ``<c>_dir`` and ``<c>_str``: weighted sides, the dominant direction, and how many agree."""
    side = lambda s: reduce(lambda a, b: a + b, [F.when(F.col(f"{c}_dir") == s, WEIGHTS[c] * _known(f"{c}_str")).otherwise(0.0) for c in components])
    out = rows.withColumns({"bull": side(1), "bear": side(-1)})
    out = out.withColumn("direction", F.when(F.col("bull") > MARGIN * F.col("bear"), 1).when(F.col("bear") > MARGIN * F.col("bull"), -1).otherwise(0))
    votes = lambda side: reduce(lambda a, b: a + b, [F.when(F.col(f"{c}_dir") == side, 1).otherwise(0) for c in components])
    out = out.withColumns({"_up": votes(1), "_down": votes(-1), "neutral": votes(0)})
    # Without a direction the larger side counts as aligned.
    most, fewest = F.greatest("_up", "_down"), F.least("_up", "_down")
    aligned = F.when(F.col("direction") == 1, F.col("_up")).when(F.col("direction") == -1, F.col("_down")).otherwise(most)
    conflicting = F.when(F.col("direction") == 1, F.col("_down")).when(F.col("direction") == -1, F.col("_up")).otherwise(fewest)
    return out.withColumns({"aligned": aligned, "conflicting": conflicting}).drop("_up", "_down")


def confluence_score(rows: DataFrame, components: list[str], risk: str = "risk", regime: str = "regime") -> DataFrame:
    """Score from 0 to 100 of rows that :func:`alignment` has passed.

    With a direction: ``(0.65 mean strength + 0.35 share that agrees) 100`` times
    the regime's fitness. The mean strength is weighted over the components that
    agree, the regime left out; none gives 20. Without a direction 20 and up to 20
    for few conflicts. The risk is taken off.
    """
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    agrees = {c: F.coalesce(F.col(f"{c}_dir") == F.col("direction"), F.lit(False)) for c in components}
    voters = [c for c in components if c != "regime"]
    weight = add([F.when(agrees[c], WEIGHTS[c]).otherwise(0.0) for c in voters])
    strength = add([F.when(agrees[c], WEIGHTS[c] * _known(f"{c}_str")).otherwise(0.0) for c in voters])
    known = add([F.when(F.col(f"{c}_dir").isNotNull(), 1).otherwise(0) for c in components])
    base = (0.65 * strength / F.nullif(weight, F.lit(0.0)) + 0.35 * F.col("aligned") / F.nullif(known, F.lit(0))) * 100 * direction_fitness(F.col(regime), F.col("direction"))
    calm = 20 + F.greatest(F.lit(0.0), 20 - 4.0 * F.col("conflicting"))
    score = F.when(F.col("direction") == 0, calm).when(weight == 0, 20.0).otherwise(base)
    return rows.withColumn("score", F.least(F.greatest(score - F.col(risk), F.lit(0.0)), F.lit(100.0)))
