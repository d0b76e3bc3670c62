"""Models over folds with MLlib, and columns derived from predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cross_section import assign_folds, average_rank, quintile


def train_walkforward(rows: DataFrame, features: list[str], target: str, folds: DataFrame, kind: str = "linear", purge_days: int = 5) -> DataFrame:
    """Scored validation rows of every fold: ``fold, symbol, ts, prediction, probability, target``.

    Each fold fits a regressor of the target and a classifier of its sign on its
    training rows; the probability is calibrated on the last tenth of them, which
    neither model sees. The loop is over the folds, which are few.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    known = rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*features, target]]))
    known = known.withColumn("label", (F.col(target) > 0).cast("double"))
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(known)
    dealt = assign_folds(ready, folds, purge_days).persist()
    out = []
    for fold in [r["fold"] for r in folds.orderBy("fold").collect()]:
        part = dealt.where(F.col("fold") == fold)
        train = part.where("role = 'train'")
        cut = train.agg(F.percentile(F.unix_timestamp(F.col("ts").cast("timestamp")), F.lit(0.9))).first()[0]
        early, tail = train.where(F.unix_timestamp(F.col("ts").cast("timestamp")) <= cut), train.where(F.unix_timestamp(F.col("ts").cast("timestamp")) > cut)
        if kind == "gbt":
            models = GBTRegressor(labelCol=target, maxIter=20, seed=1), GBTClassifier(labelCol="label", maxIter=20, seed=1)
        else:
            models = LinearRegression(labelCol=target, regParam=0.1), LogisticRegression(labelCol="label", regParam=0.1)
        regressor, classifier = models[0].fit(early), models[1].fit(early)
        raw = lambda df: classifier.transform(df).withColumn("score", _second("rawPrediction")).drop("prediction", "probability", "rawPrediction")  # noqa: E731, B023
        platt = LogisticRegression(featuresCol="one", labelCol="label").fit(VectorAssembler(inputCols=["score"], outputCol="one").transform(raw(tail)))
        val = VectorAssembler(inputCols=["score"], outputCol="one").transform(raw(part.where("role = 'val'")))
        val = platt.transform(val).withColumn("p", _second("probability")).drop("prediction", "probability", "rawPrediction", "one", "score")
        out.append(regressor.transform(val).select("fold", "symbol", "ts", "prediction", F.col("p").alias("probability"), F.col(target).alias("target")))
    return reduce(DataFrame.unionByName, out)


def _second(vector: str) -> Column:
    """The second entry of an ML vector."""
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(vector))[1]


def score_universe(rows: DataFrame) -> DataFrame:
    """From ``prediction, probability`` per date: expected drawdown, confidence, percentile rank (ties by prediction)."""
    day = Window.partitionBy("ts")
    rank = F.rank().over(day.orderBy("probability", "prediction")) / F.count(F.lit(1)).over(day)
    return rows.withColumns({"expected_drawdown": F.least("prediction", F.lit(0.0)), "confidence": 2 * F.abs(F.col("probability") - 0.5), "rank": rank})


def prediction_outcomes(rows: DataFrame, returns: list[str]) -> DataFrame:
    """Was the direction right at each horizon, quintiles of rank and outcome, return implied by the rank."""
    right = {f"right_{r}": F.when(F.col(r).isNotNull(), (F.col("probability") >= 0.5) == (F.col(r) > 0)) for r in returns}
    first = returns[0]
    actual = average_rank(first, ["ts"]) / F.count(first).over(Window.partitionBy("ts"))
    return rows.withColumns(right | {"predicted_quintile": quintile(F.col("rank")), "actual_quintile": quintile(actual), "implied_return": (F.col("rank") - 0.5) * 0.02})
