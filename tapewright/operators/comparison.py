"""Linear models of several feature sets or tiers, trained on the same folds and compared on the same dates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cross_section import assign_folds, daily_ic
from .outcomes import tstat_p


def _moments(rows: DataFrame, features: list[str], target: str, by: list[str]) -> DataFrame:
    """``means, covariances`` of the features and the target (last) in each group, in one pass."""
    columns = [*features, target]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return rows.groupBy(*by).agg(F.array(*[F.avg(c) for c in columns]).alias("means"), F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("covariances"))


def fit_sets(moments: DataFrame, features: list[str], sets: Mapping[str, Iterable[str]], by: list[str], ridge: float = 0.0) -> DataFrame:
    """``*by, name, intercept, weights`` (one for each feature, 0 outside the set) of every set's least-squares fit.

    A group's moments are one row whatever its number of training rows. ``ridge`` is
    taken in units of the features' variances. A feature without spread weighs 0.
    """
    chosen = {name: [features.index(f) for f in use] for name, use in sets.items()}
    k = len(features)

    def solve(batches: Iterator):
        import numpy as np
        import pandas as pd

        upper = np.triu_indices(k + 1)
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                means = np.asarray(row["means"], float)
                cov = np.zeros((k + 1, k + 1))
                cov[upper] = row["covariances"]
                cov = cov + np.triu(cov, 1).T
                for name, use in chosen.items():
                    spread = np.sqrt(np.diag(cov)[use])
                    known = spread > 0
                    at = np.asarray(use, int)[known]
                    scaled = cov[np.ix_(at, at)] / np.outer(spread[known], spread[known]) + ridge * np.eye(len(at))
                    weights = np.zeros(k)
                    weights[at] = np.linalg.lstsq(scaled, cov[at, k] / spread[known], rcond=None)[0] / spread[known]
                    out.append((*(row[c] for c in by), name, means[k] - weights @ means[:k], weights.tolist()))
            yield pd.DataFrame(out, columns=[*by, "name", "intercept", "weights"])

    kinds = ", ".join(f"{c} {moments.schema[c].dataType.simpleString()}" for c in by)
    return moments.mapInPandas(solve, f"{kinds}, name string, intercept double, weights array<double>")


def _scored(val: DataFrame, fits: DataFrame, features: list[str], on: list[str]) -> DataFrame:
    """Validation rows with the prediction of every fit of their group."""
    guess = reduce(lambda a, b: a + b, [F.col("weights")[i] * F.col(f) for i, f in enumerate(features)], F.col("intercept"))
    return val.join(fits, on).withColumn("prediction", guess)


def _paired(ics: DataFrame, by: list[str], baseline: str) -> DataFrame:
    """``ics`` (``fold, *by, name, ts, ic``) summed up by name, with the mean difference to the baseline on the dates of both and its p."""
    base = ics.where(F.col("name") == baseline).select("fold", *by, "ts", F.col("ic").alias("base_ic"))
    met = ics.join(base, ["fold", *by, "ts"]).withColumn("_d", F.col("ic") - F.col("base_ic"))
    out = met.groupBy(*by, "name").agg(
        F.count(F.lit(1)).alias("n_dates"), F.avg("ic").alias("mean_ic"), F.avg("base_ic").alias("baseline_ic"), F.avg("_d").alias("difference"), F.stddev_samp("_d").alias("_s"),
    )
    # Differences of equal predictions are traces of floats at most.
    return out.withColumn("p_value", tstat_p(F.col("n_dates"), F.col("difference"), F.when(F.col("_s") > 1e-9, F.col("_s")))).drop("_s")


def _known(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def _ics(scored: DataFrame, by: list[str], target: str) -> DataFrame:
    """Rank ICs of the predictions on each date, by group and name."""
    day = F.struct("ts", *by, "name").alias("_day")
    out = daily_ic(scored.select(day, "prediction", target), ["prediction"], target, by="_day")
    return out.select("_day.*", "ic")


def feature_set_compare(rows: DataFrame, sets: Mapping[str, Iterable[str]], target: str, folds: DataFrame, baseline: str, ridge: float = 0.0, purge_days: int = 5) -> DataFrame:
    """Models of several feature sets side by side: ``name, n_features, n_dates, mean_ic, baseline_ic, difference, p_value``.

    Every set is fitted on each fold's training rows and scored by its rank ICs on
    the fold's validation dates; ``difference`` is the mean over the dates that
    both have, ``p_value`` the paired test of it (null for the baseline itself).
    Only rows with all features and the target take part, so that all sets see the
    same ones. One pass over the training rows serves all sets: sums over the
    features' pairs, a row for each fold. An empty table gives an empty one.
    """
    sets = {name: list(use) for name, use in sets.items()}
    features = list(dict.fromkeys(f for use in sets.values() for f in use))
    dealt = assign_folds(_known(rows, [*features, target]), folds, purge_days)
    fits = fit_sets(_moments(dealt.where("role = 'train'"), features, target, ["fold"]), features, sets, ["fold"], ridge)
    ics = _ics(_scored(dealt.where("role = 'val'"), fits, features, ["fold"]), ["fold"], target)
    sizes = F.create_map(*[F.lit(x) for name, use in sets.items() for x in (name, len(use))])
    return _paired(ics, [], baseline).select("name", sizes[F.col("name")].alias("n_features"), "n_dates", "mean_ic", "baseline_ic", "difference", "p_value")


def tier_compare(rows: DataFrame, features: Iterable[str], target: str, folds: DataFrame, tier: str = "tier", ridge: float = 0.0, purge_days: int = 5) -> DataFrame:
    """Does a tier gain from a model of its own? ``tier, n_dates, mean_ic, baseline_ic, difference, p_value``.

    In every fold one model is fitted on all training rows and one on each tier's;
    both score the tier's validation rows, and are compared on the same dates.
    ``baseline_ic`` is that of the common model. Rows without a tier, a feature or
    the target take no part; a tier without training rows in a fold has no dates there.
    """
    features = list(features)
    dealt = assign_folds(_known(rows, [*features, target, tier]), folds, purge_days).withColumnRenamed(tier, "_tier")
    train, val = dealt.where("role = 'train'"), dealt.where("role = 'val'")
    own = fit_sets(_moments(train, features, target, ["fold", "_tier"]), features, {"own": features}, ["fold", "_tier"], ridge)
    common = fit_sets(_moments(train, features, target, ["fold"]), features, {"common": features}, ["fold"], ridge)
    scored = [_scored(val, own, features, ["fold", "_tier"]), _scored(val, common, features, ["fold"])]
    columns = ["fold", "_tier", "ts", "name", "prediction", target]
    ics = _ics(scored[0].select(columns).unionByName(scored[1].select(columns)), ["fold", "_tier"], target)
    return _paired(ics, ["_tier"], "common").where("name = 'own'").select(F.col("_tier").alias(tier), "n_dates", "mean_ic", "baseline_ic", "difference", "p_value")
