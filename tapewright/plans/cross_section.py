"""Queries within dates over weekly bars, and model metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import lead, rounded
from ..operators import cross_section as ops
from ..operators.features import log_return, roc
from ..sources import tables
from .features import _out
from .registry import WEEKLY, query, s_lag, s_lead, s_round

PANEL = f"""{WEEKLY}, panel AS (SELECT symbol, ts, close / {s_lag("close", 10)} - 1 AS roc_10, ln(close / {s_lag("close", 5)}) AS return_5d, volume,
    ({s_lead("close", 4)} / close - 1) * 100 AS target FROM weekly)"""


def _panel(spark, sf):
    bars = tables.weekly_bars(spark, sf)
    return bars.select("symbol", "ts", roc(10).alias("roc_10"), log_return(5).alias("return_5d"), "volume", ((lead("close", 4) / F.col("close") - 1) * 100).alias("target"))


def _rank(c: str, by: str = "ts") -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {by}, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0 END"


@query(
    "rank_normalize",
    f"WITH {PANEL} SELECT symbol, ts, {', '.join(s_round(f'({_rank(c)}) / count({c}) OVER (PARTITION BY ts)') + f' AS {c}_rank' for c in ('roc_10', 'volume'))} FROM panel",
)
def _(spark, sf):
    return _out(ops.rank_normalize(_panel(spark, sf), ["roc_10", "volume"]), "roc_10_rank", "volume_rank")


@query(
    "quintile_rank",
    f"""WITH {PANEL}, r AS (SELECT symbol, ts, ({_rank("roc_10")}) / count(roc_10) OVER (PARTITION BY ts) AS p, ({_rank("target")}) / count(target) OVER (PARTITION BY ts) AS t FROM panel),
    q AS (SELECT symbol, ts, CAST(least(greatest(ceil(p * 5), 1), 5) AS INT) AS predicted, CAST(least(greatest(ceil(t * 5), 1), 5) AS INT) AS actual FROM r WHERE p IS NOT NULL AND t IS NOT NULL)
    SELECT symbol, ts, predicted, actual, predicted = 5 AND actual >= 4 AS rank_hit FROM q""",
)
def _(spark, sf):
    rows = ops.rank_normalize(_panel(spark, sf), ["roc_10", "target"]).where("roc_10_rank is not null and target_rank is not null")
    rows = rows.select("symbol", "ts", ops.quintile(F.col("roc_10_rank")).alias("predicted"), ops.quintile(F.col("target_rank")).alias("actual"))
    return rows.withColumn("rank_hit", (F.col("predicted") == 5) & (F.col("actual") >= 4))


_IC = f"""{PANEL}, l AS ({" UNION ALL ".join(f"SELECT ts, '{f}' AS feature, {f} AS x, target AS y FROM panel WHERE {f} IS NOT NULL AND target IS NOT NULL" for f in ("roc_10", "return_5d", "volume"))}),
    k AS (SELECT ts, feature, {_rank("x", "ts, feature")} AS rx, {_rank("y", "ts, feature")} AS ry FROM l),
    ics AS (SELECT ts, feature, count(*) AS n, corr(rx, ry) AS ic FROM k GROUP BY ts, feature HAVING count(*) >= 5 AND count(DISTINCT rx) > 1 AND count(DISTINCT ry) > 1)"""
FEATURES = ["roc_10", "return_5d", "volume"]


@query("daily_ic", f"WITH {_IC} SELECT ts, feature, n, {s_round('ic')} AS ic FROM ics")
def _(spark, sf):
    return _out(ops.daily_ic(_panel(spark, sf), FEATURES, "target"), "ic", keys=("ts", "feature", "n"))


@query(
    "ic_summary",
    f"""WITH {_IC}, s AS (SELECT feature, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(CASE WHEN ic > 1e-12 THEN 1 ELSE 0 END) AS positive, count(*) AS n_dates FROM ics GROUP BY feature)
    SELECT feature, n_dates, {", ".join(f"{s_round(c)} AS {c}" for c in ("mean_ic", "std_ic", "positive"))}, {s_round("mean_ic / std_ic")} AS ir, {s_round("mean_ic / std_ic * sqrt(n_dates)")} AS t_stat FROM s""",
)
def _(spark, sf):
    return _out(ops.ic_summary(ops.daily_ic(_panel(spark, sf), FEATURES, "target")), "mean_ic", "std_ic", "positive", "ir", "t_stat", keys=("feature", "n_dates"))


@query(
    "long_short",
    f"""WITH {PANEL}, d AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY roc_10 DESC, symbol) AS t, row_number() OVER (PARTITION BY ts ORDER BY roc_10, symbol) AS l FROM panel WHERE roc_10 IS NOT NULL AND target IS NOT NULL),
    g AS (SELECT ts, avg(CASE WHEN t <= 3 THEN target END) AS top, avg(CASE WHEN l <= 3 THEN target END) AS bottom, count(*) AS n FROM d GROUP BY ts HAVING count(*) >= 6)
    SELECT ts, n, {s_round("top")} AS top, {s_round("bottom")} AS bottom, {s_round("top - bottom")} AS spread FROM g""",
)
def _(spark, sf):
    return _out(ops.long_short(_panel(spark, sf), "roc_10", "target"), "top", "bottom", "spread", keys=("ts", "n"))


@query(
    "decile_table",
    f"""WITH {PANEL}, d AS (SELECT *, ntile(10) OVER (PARTITION BY ts ORDER BY roc_10, symbol) AS decile FROM panel WHERE roc_10 IS NOT NULL)
    SELECT CAST(decile AS INT) AS decile, count(*) AS n, {s_round("avg(roc_10)")} AS mean_score, {s_round("avg(target)")} AS mean_target, {s_round("avg(CASE WHEN target > 0 THEN 1 WHEN target <= 0 THEN 0 END)")} AS positive FROM d GROUP BY decile""",
)
def _(spark, sf):
    return _out(ops.decile_table(_panel(spark, sf), "roc_10", "target"), "mean_score", "mean_target", "positive", keys=("decile", "n"))


_SCORES = "scores AS (SELECT l.doc_id, l.quality AS label, (d.n_chars % 97) / 97.0::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id))"


def _scores(spark, sf):
    docs = tables.read(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 97) / 97.0).alias("score"))
    return tables.read(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")


@query(
    "classification_metrics",
    f"""WITH {_SCORES}, c AS (SELECT *, least(greatest(score, 1e-15), 1 - 1e-15) AS p FROM scores), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS k FROM c),
    a AS (SELECT count(*) AS n, sum(label) AS pos, sum(CASE WHEN label = 1 THEN k END) AS s, avg((p - label) * (p - label)) AS brier, avg(-(label * ln(p) + (1 - label) * ln(1 - p))) AS log_loss, avg(CASE WHEN (p >= 0.5) = (label = 1) THEN 1 ELSE 0 END) AS accuracy FROM r)
    SELECT n, {s_round("(s - pos * (pos + 1) / 2.0) / (pos * (n - pos))")} AS auc, {s_round("brier")} AS brier, {s_round("log_loss")} AS log_loss, {s_round("accuracy")} AS accuracy FROM a""",
)
def _(spark, sf):
    return _out(ops.binary_metrics(_scores(spark, sf), "score", "label"), "auc", "brier", "log_loss", "accuracy", keys=("n",))


@query(
    "regression_metrics",
    f"WITH {PANEL}, e AS (SELECT roc_10 * 100 - target AS e FROM panel) SELECT count(e) AS n, {s_round('sqrt(avg(e * e))')} AS rmse, {s_round('avg(abs(e))')} AS mae, {s_round('avg(e)')} AS bias FROM e",
)
def _(spark, sf):
    rows = _panel(spark, sf).withColumn("prediction", F.col("roc_10") * 100)
    return _out(ops.regression_metrics(rows, "prediction", "target"), "rmse", "mae", "bias", keys=("n",))


_FOLDS = f"""{WEEKLY}, b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM weekly), s AS (SELECT lo, unnest(generate_series(0, 20)) AS fold, hi FROM b),
    folds AS (SELECT CAST(fold AS INT) AS fold, lo AS train_start, CAST(lo + to_months(36 + 12 * CAST(fold AS INT)) AS DATE) AS val_start, hi FROM s WHERE CAST(lo + to_months(36 + 12 * CAST(fold AS INT)) AS DATE) <= CAST(hi - INTERVAL 12 MONTH AS DATE))"""
_FOLD_COLS = "fold, train_start, val_start - 1 AS train_end, val_start, CAST(val_start + INTERVAL 12 MONTH AS DATE) - 1 AS val_end"


def _folds(bars):
    return ops.generate_folds(bars.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")))


@query("generate_folds", f"WITH {_FOLDS} SELECT {_FOLD_COLS} FROM folds")
def _(spark, sf):
    return _folds(tables.weekly_bars(spark, sf))


@query(
    "assign_folds",
    f"""WITH {_FOLDS}, f AS (SELECT {_FOLD_COLS} FROM folds)
    SELECT symbol, ts, fold, CASE WHEN ts BETWEEN val_start AND val_end THEN 'val' ELSE 'train' END AS role FROM weekly JOIN f ON (ts >= train_start AND ts < val_start - 5) OR ts BETWEEN val_start AND val_end""",
)
def _(spark, sf):
    bars = tables.weekly_bars(spark, sf)
    return ops.assign_folds(bars, _folds(bars)).select("symbol", "ts", "fold", "role")


@query(
    "quantile_table",
    f"""WITH {PANEL}, c AS (SELECT quantile_cont(roc_10, [0.2, 0.4, 0.6, 0.8]) AS cuts FROM panel),
    r AS (SELECT roc_10, target, CAST(1 + len(list_filter(cuts, lambda x: x < roc_10)) AS INT) AS band FROM panel, c WHERE roc_10 IS NOT NULL)
    SELECT band, count(*) AS n, {s_round("avg(roc_10)")} AS mean_value, {s_round("avg(target)")} AS mean_target FROM r GROUP BY band""",
)
def _(spark, sf):
    return _out(ops.quantile_table(_panel(spark, sf), "roc_10", 5, "target"), "mean_value", "mean_target", keys=("band", "n"))
