"""Queries over models and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparison, cross_section, models as ops
from ..sources import tables
from .cross_section import _FOLD_COLS, _FOLDS, PANEL, _folds, _panel, _rank
from .features import _out
from .outcomes import _tail
from .registry import WEEKLY, query, s_round

#: A prediction and a probability made from features stand in for a model's.
_PRED = f"{PANEL}, pr AS (SELECT symbol, ts, return_5d * 10 AS prediction, 1 / (1 + exp(-roc_10)) AS probability, target FROM panel WHERE roc_10 IS NOT NULL AND return_5d IS NOT NULL), sc AS (SELECT *, rank() OVER (PARTITION BY ts ORDER BY probability, prediction) / count(*) OVER (PARTITION BY ts) AS rk FROM pr)"


def _predictions(spark, sf):
    rows = _panel(spark, sf).where("roc_10 is not null and return_5d is not null")
    return ops.score_universe(rows.select("symbol", "ts", (F.col("return_5d") * 10).alias("prediction"), (1 / (1 + F.exp(-F.col("roc_10")))).alias("probability"), "target"))


@query("score_universe", f"WITH {_PRED} SELECT symbol, ts, {s_round('least(prediction, 0)')} AS expected_drawdown, {s_round('2 * abs(probability - 0.5)')} AS confidence, {s_round('rk')} AS rank FROM sc")
def _(spark, sf):
    return _out(_predictions(spark, sf), "expected_drawdown", "confidence", "rank")


@query(
    "prediction_outcomes",
    f"""WITH {_PRED}, a AS (SELECT *, ({_rank("target")}) / count(target) OVER (PARTITION BY ts) AS ar FROM sc)
    SELECT symbol, ts, CASE WHEN target IS NOT NULL THEN (probability >= 0.5) = (target > 0) END AS right_target, CAST(least(greatest(ceil(rk * 5), 1), 5) AS INT) AS predicted_quintile,
           CAST(CASE WHEN ar IS NOT NULL THEN least(greatest(ceil(ar * 5), 1), 5) END AS INT) AS actual_quintile, {s_round("(rk - 0.5) * 0.02")} AS implied_return FROM a""",
)
def _(spark, sf):
    out = ops.prediction_outcomes(_predictions(spark, sf), ["target"])
    out = out.withColumn("actual_quintile", F.when(F.col("target").isNotNull(), F.col("actual_quintile")))
    return _out(out, "implied_return", keys=("symbol", "ts", "right_target", "predicted_quintile", "actual_quintile"))


@query("train_walkforward")
def _(spark, sf):
    rows = _panel(spark, sf)
    scored = ops.train_walkforward(rows, ["roc_10", "return_5d", "volume"], "target", _folds(tables.weekly_bars(spark, sf)))
    ics = cross_section.daily_ic(scored, ["prediction"], "target")
    return ics.groupBy("feature").agg(F.avg("ic").alias("mean_ic"), F.count(F.lit(1)).alias("n_dates"))


#: The panel's rows by fold and role, with a tier: the half of the brands that trades more is 1.
_DEALT = f"""{PANEL}{_FOLDS.removeprefix(WEEKLY)}, f AS (SELECT {_FOLD_COLS} FROM folds),
    tiers AS (SELECT symbol, ntile(2) OVER (ORDER BY sum(volume) DESC, symbol) AS tier FROM weekly GROUP BY symbol),
    dealt AS (
        SELECT panel.*, tier, fold, ts BETWEEN val_start AND val_end AS val FROM panel JOIN tiers USING (symbol)
        JOIN f ON (ts >= train_start AND ts < val_start - 5) OR ts BETWEEN val_start AND val_end
        WHERE roc_10 IS NOT NULL AND return_5d IS NOT NULL AND volume IS NOT NULL AND target IS NOT NULL)"""
#: Least squares of one and of two features from their moments.
_ONE = "covar_pop(target, {0}) / var_pop({0})"
_TWO = "(covar_pop(target, {0}) * var_pop({1}) - covar_pop(target, {1}) * covar_pop({0}, {1})) / (var_pop({0}) * var_pop({1}) - covar_pop({0}, {1}) ** 2)"
_BOTH = f"{_TWO.format('roc_10', 'return_5d')} AS b_roc, {_TWO.format('return_5d', 'roc_10')} AS b_ret"


def _paired(keys: str, baseline: str) -> str:
    """Rank ICs of ``scored (fold, keys, name, ts, p, target)`` and the paired comparison with the baseline, by keys and name."""
    by = f"fold, {keys}name, ts"
    rank = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"
    return f"""ranked AS (SELECT {by}, {rank("p")} AS rx, {rank("target")} AS ry FROM scored),
    ics AS (SELECT {by}, corr(rx, ry) AS ic FROM ranked GROUP BY {by} HAVING count(*) >= 5 AND var_pop(rx) > 0 AND var_pop(ry) > 0),
    g AS (
        SELECT {keys}a.name AS name, count(*) AS n, avg(a.ic) AS mean_ic, avg(b.ic) AS baseline_ic, avg(a.ic - b.ic) AS mean, stddev_samp(a.ic - b.ic) AS std
        FROM ics a JOIN (SELECT fold, {keys}ts, ic FROM ics WHERE name = '{baseline}') b USING (fold, {keys}ts) GROUP BY {keys}a.name)"""


_COMPARED = f"""n AS n_dates, {s_round("mean_ic")} AS mean_ic, {s_round("baseline_ic")} AS baseline_ic, {s_round("mean")} AS difference,
    {s_round(f"CASE WHEN n > 1 AND std > 1e-9 THEN {_tail('(mean / (std / sqrt(n)))')} END")} AS p_value"""
SETS = {"momentum": ["roc_10"], "drift": ["return_5d"], "activity": ["volume"], "prices": ["roc_10", "return_5d"]}


@query(
    "feature_set_compare",
    f"""WITH {_DEALT}, fits AS (
        SELECT fold, {_ONE.format("roc_10")} AS b_1, {_ONE.format("return_5d")} AS b_2, {_ONE.format("volume")} AS b_3, {_BOTH} FROM dealt WHERE NOT val GROUP BY fold),
    scored AS (
        SELECT fold, ts, target, unnest(['momentum', 'drift', 'activity', 'prices']) AS name, unnest([b_1 * roc_10, b_2 * return_5d, b_3 * volume, b_roc * roc_10 + b_ret * return_5d]) AS p
        FROM dealt JOIN fits USING (fold) WHERE val),
    {_paired("", "momentum")} SELECT name, CASE WHEN name = 'prices' THEN 2 ELSE 1 END AS n_features, {_COMPARED} FROM g""",
)
def _(spark, sf):
    out = comparison.feature_set_compare(_panel(spark, sf), SETS, "target", _folds(tables.weekly_bars(spark, sf)), "momentum")
    return _out(out, "mean_ic", "baseline_ic", "difference", "p_value", keys=("name", "n_features", "n_dates"))


@query(
    "tier_compare",
    f"""WITH {_DEALT}, own AS (SELECT fold, tier, {_BOTH} FROM dealt WHERE NOT val GROUP BY fold, tier),
    common AS (SELECT fold, {_BOTH} FROM dealt WHERE NOT val GROUP BY fold),
    scored AS (
        SELECT fold, tier, 'own' AS name, ts, target, b_roc * roc_10 + b_ret * return_5d AS p FROM dealt JOIN own USING (fold, tier) WHERE val
        UNION ALL SELECT fold, tier, 'common', ts, target, b_roc * roc_10 + b_ret * return_5d FROM dealt JOIN common USING (fold) WHERE val),
    {_paired("tier, ", "common")} SELECT CAST(tier AS INT) AS tier, {_COMPARED} FROM g WHERE name = 'own'""",
)
def _(spark, sf):
    from pyspark.sql.window import Window

    bars = tables.weekly_bars(spark, sf)
    traded = bars.groupBy("symbol").agg(F.sum("volume").alias("_v"))
    tiers = traded.select("symbol", F.ntile(2).over(Window.orderBy(F.desc("_v"), "symbol")).alias("tier"))
    rows = _panel(spark, sf).where("volume is not null").join(tiers, "symbol")
    out = comparison.tier_compare(rows, ["roc_10", "return_5d"], "target", _folds(bars))
    return _out(out, "mean_ic", "baseline_ic", "difference", "p_value", keys=("tier", "n_dates"))
