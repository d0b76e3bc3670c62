"""Ranks within dates, rank correlations, deciles, folds and model metrics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import sum_before

#: A correlation that is no larger counts as zero: sums of floats leave such traces.
EPSILON = 1e-12


def average_rank(c: str, by: Iterable[str]) -> Column:
    """Rank from 1 with ties at their mean, among the rows where ``c`` is known."""
    by = list(by)
    known = Window.partitionBy(*by, F.col(c).isNull())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, c))
    return F.when(F.col(c).isNotNull(), F.rank().over(known.orderBy(c)) + (ties - 1) / 2)


def rank_normalize(rows: DataFrame, columns: Iterable[str], by: str = "ts") -> DataFrame:
    """Percentile ranks within a date; ties share their mean rank and null stays null."""
    out = rows
    for c in columns:
        out = out.withColumn(f"{c}_rank", average_rank(c, [by]) / F.count(c).over(Window.partitionBy(by)))
    return out


def quintile(rank: Column) -> Column:
    return F.least(F.greatest(F.ceil(rank * 5), F.lit(1)), F.lit(5)).cast("int")


def daily_ic(rows: DataFrame, features: Iterable[str], target: str, by: str = "ts", least: int = 5) -> DataFrame:
    """Spearman correlation of each feature with the target on each date with enough distinct values."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])
    long = rows.select(by, F.col(target).alias("y"), F.inline(pairs)).where("x is not null and y is not null")
    ranked = long.withColumns({"rx": average_rank("x", [by, "feature"]), "ry": average_rank("y", [by, "feature"])})
    # Correlation from sums of ranks, which are exact multiples of one half.
    n = F.count(F.lit(1))
    out = ranked.groupBy(by, "feature").agg(
        n.alias("n"), F.sum("rx").alias("sx"), F.sum("ry").alias("sy"), F.sum(F.col("rx") * F.col("rx")).alias("sxx"), F.sum(F.col("ry") * F.col("ry")).alias("syy"), F.sum(F.col("rx") * F.col("ry")).alias("sxy"),
    )
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    ic = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)
    return out.where((F.col("n") >= least) & (vx > 0) & (vy > 0)).select(by, "feature", "n", ic.alias("ic"))


def ic_summary(ics: DataFrame) -> DataFrame:
    """Mean, deviation, information ratio, t and share of positive dates by feature."""
    out = ics.groupBy("feature").agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("std_ic"), F.avg((F.col("ic") > EPSILON).cast("int")).alias("positive"), F.count(F.lit(1)).alias("n_dates"))
    ratio = F.when(F.col("std_ic") > 0, F.col("mean_ic") / F.col("std_ic"))
    return out.withColumns({"ir": ratio, "t_stat": ratio * F.sqrt("n_dates")})


def long_short(rows: DataFrame, score: str, target: str, n: int = 3, by: str = "ts") -> DataFrame:
    """Per date the mean target of the ``n`` best less that of the ``n`` worst by score."""
    day = rows.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    top = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "symbol"))
    low = F.row_number().over(Window.partitionBy(by).orderBy(F.asc(score), "symbol"))
    day = day.withColumns({"_t": top, "_l": low})
    out = day.groupBy(by).agg(F.avg(F.when(F.col("_t") <= n, F.col(target))).alias("top"), F.avg(F.when(F.col("_l") <= n, F.col(target))).alias("bottom"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") >= 2 * n).withColumn("spread", F.col("top") - F.col("bottom"))


def decile_table(rows: DataFrame, score: str, target: str) -> DataFrame:
    """Equal-count deciles by score over a total order: size, mean score, mean target, share positive."""
    cut = rows.where(F.col(score).isNotNull()).withColumn("_day", F.col("ts"))
    day = cut.withColumn("decile", F.ntile(10).over(Window.partitionBy("ts").orderBy(score, "symbol")))
    return day.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(target).alias("mean_target"), F.avg((F.col(target) > 0).cast("int")).alias("positive"))


def binary_metrics(rows: DataFrame, score: str, label: str) -> DataFrame:
    """AUC (ties count half), Brier score, log loss and accuracy, from counts by distinct score.

    Scores are first reduced to their distinct values, and the running sum for the
    AUC is taken by ranges of them.
    """
    p = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    y = F.col(label).cast("double")
    cells = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"), F.sum((p - y) * (p - y)).alias("se"),
        F.sum(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("ll"), F.sum(((p >= 0.5) == (y == 1)).cast("int")).alias("ok"),
    )
    cells = sum_before(cells.withColumn("_one", F.lit(1)), ["_one"], "s", "neg").withColumn("won", F.col("pos") * (F.col("_below") + F.col("neg") / 2))
    out = cells.agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "won", "se", "ll", "ok")])
    n = F.col("pos") + F.col("neg")
    return out.select(
        n.cast("long").alias("n"), (F.col("won") / (F.col("pos") * F.col("neg"))).alias("auc"), (F.col("se") / n).alias("brier"), (F.col("ll") / n).alias("log_loss"), (F.col("ok") / n).alias("accuracy"),
    )


def regression_metrics(rows: DataFrame, prediction: str, target: str) -> DataFrame:
    e = F.col(prediction) - F.col(target)
    return rows.where(e.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


def generate_folds(bounds: DataFrame, train_years: int = 3, val_months: int = 12) -> DataFrame:
    """Expanding folds ``fold, train_start, train_end, val_start, val_end`` from one row ``lo, hi``."""
    first = F.add_months("lo", 12 * train_years)
    last = F.add_months("hi", -val_months)
    starts = F.when(first <= last, F.sequence(first, last, F.expr(f"interval {val_months} months")))
    rows = bounds.select("lo", F.posexplode(starts).alias("fold", "val_start"))
    return rows.select("fold", F.col("lo").alias("train_start"), F.date_sub("val_start", 1).alias("train_end"), "val_start", F.date_sub(F.add_months("val_start", val_months), 1).alias("val_end"))


def assign_folds(rows: DataFrame, folds: DataFrame, purge_days: int = 5) -> DataFrame:
    """Rows by fold and role; training rows within some days of the validation start are dropped.

    The distinct dates meet the folds, both few; rows then meet their dates by an equal key.
    """
    ts = F.col("ts")
    train = (ts >= F.col("train_start")) & (ts < F.date_sub("val_start", purge_days))
    val = ts.between(F.col("val_start"), F.col("val_end"))
    dates = rows.select("ts").distinct().join(folds, train | val).withColumn("role", F.when(val, "val").otherwise("train"))
    return rows.join(dates, "ts")


def quantile_table(rows: DataFrame, column: str, k: int, target: str) -> DataFrame:
    """Bands with equal frequencies from the data's own quantiles; the last band is closed."""
    cuts = rows.agg(F.percentile(column, F.array(*[F.lit(i / k) for i in range(1, k)])).alias("_cuts"))
    band = 1 + F.size(F.filter("_cuts", lambda x: x < F.col(column)))
    out = rows.where(F.col(column).isNotNull()).join(F.broadcast(cuts)).withColumn("band", band)
    return out.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean_value"), F.avg(target).alias("mean_target"))


def fdr_bh(tests: DataFrame, p: str = "p_value", alpha: float = 0.05, by: Iterable[str] = ()) -> DataFrame:
    """Benjamini-Hochberg: all tests up to the last p at or below ``rank / n * alpha`` are significant."""
    by = list(by) or [F.lit(0)]
    w = Window.partitionBy(*by)
    rows = tests.where(F.col(p).isNotNull()).withColumns({"_rank": F.rank().over(w.orderBy(p)), "_n": F.count(F.lit(1)).over(w)})
    rows = rows.withColumn("_ties", F.count(F.lit(1)).over(Window.partitionBy(*by, p)))
    cut = F.max(F.when(F.col(p) <= (F.col("_rank") + F.col("_ties") - 1) / F.col("_n") * alpha, F.col(p))).over(w)
    return rows.withColumn("significant", F.coalesce(F.col(p) <= cut, F.lit(False))).drop("_rank", "_n", "_ties")
