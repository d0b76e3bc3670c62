"""Feature sets and tiers compared on planted signals, and fits against numpy."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from tapewright.operators import comparison

START = datetime.date(2020, 1, 6)


def panel(spark, slope=lambda symbol: 1.0):
    """Eighty weeks of twelve symbols: the target follows ``good`` and not ``noise``."""
    rnd, rows = np.random.default_rng(3), []
    for week in range(80):
        for symbol in range(12):
            good, noise = rnd.normal(size=2).tolist()
            rows.append((f"s{symbol}", START + datetime.timedelta(weeks=week), good, noise, 5.0, slope(symbol) * good + 0.5 * float(rnd.normal()), symbol % 2))
    return spark.createDataFrame(rows, "symbol string, ts date, good double, noise double, flat double, target double, tier int")


def folds(spark):
    at = lambda w: START + datetime.timedelta(weeks=w)
    return spark.createDataFrame([(k, START, at(a - 1), at(a), at(a + 20)) for k, a in enumerate((30, 55))], "fold int, train_start date, train_end date, val_start date, val_end date")


def test_the_planted_feature_wins(spark):
    sets = {"base": ["noise"], "good": ["good"], "both": ["noise", "good"], "flat": ["flat"]}
    got = {r["name"]: r for r in comparison.feature_set_compare(panel(spark), sets, "target", folds(spark), "base").collect()}
    assert set(got) == {"base", "good", "both"}  # a prediction without spread has no rank IC
    assert got["base"]["difference"] == 0 and got["base"]["p_value"] is None
    assert got["good"]["n_dates"] == 42 and got["both"]["n_features"] == 2
    for name in ("good", "both"):
        assert got[name]["mean_ic"] > 0.7 and got[name]["difference"] > 0.4 and got[name]["p_value"] < 1e-6
        assert abs(got[name]["mean_ic"] - got[name]["baseline_ic"] - got[name]["difference"]) < 1e-9


def test_fits_equal_least_squares(spark):
    rows = panel(spark)
    fits = comparison.fit_sets(comparison._moments(rows, ["good", "noise", "flat"], "target", ["tier"]), ["good", "noise", "flat"], {"a": ["noise"], "b": ["noise", "good", "flat"]}, ["tier"])
    found = {(r["tier"], r["name"]): (r["intercept"], *r["weights"]) for r in fits.collect()}
    data = rows.toPandas()
    for tier in (0, 1):
        part = data[data["tier"] == tier]
        for name, use in (("a", ["noise"]), ("b", ["noise", "good"])):
            x = np.column_stack([np.ones(len(part)), part[use]])
            want = np.linalg.lstsq(x, part["target"].to_numpy(), rcond=None)[0]
            intercept, good, noise, flat = found[tier, name]
            assert np.allclose([intercept, noise, good][: len(use) + 1], want) and flat == 0


def test_tiers_with_opposite_signs_gain_from_models_of_their_own(spark):
    rows = panel(spark, slope=lambda symbol: 1.0 if symbol % 2 else -0.8)
    got = {r["tier"]: r for r in comparison.tier_compare(rows, ["good", "noise"], "target", folds(spark)).collect()}
    assert set(got) == {0, 1}
    assert got[0]["mean_ic"] > 0.5 and got[0]["difference"] > 0.5 and got[0]["p_value"] < 1e-6
    assert comparison.tier_compare(rows.where("false"), ["good"], "target", folds(spark)).count() == 0


def test_rows_without_values_take_no_part(spark):
    rows = panel(spark)
    holes = rows.select("symbol", F.date_add("ts", 1).alias("ts"), F.lit(None).cast("double").alias("good"), "noise", "flat", F.lit(1e9).alias("target"), "tier")
    sets = {"base": ["noise"], "good": ["good"]}
    first = comparison.feature_set_compare(rows, sets, "target", folds(spark), "base")
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, comparison.feature_set_compare(rows.unionByName(holes), sets, "target", folds(spark), "base").collect()))
