"""The feature matrix as one dataset with a partition for each date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_feature_matrix(rows: DataFrame, path: str, at: str = "ts") -> None:
    """Write a wide matrix, partitioned by date; dates that it holds are replaced, others stay. An empty one is an error."""
    if rows.isEmpty():
        raise ValueError("the feature matrix is empty")
    # One file a date: the rows of a date come together before they are written.
    out = rows.withColumn("date", F.to_date(at)).repartition("date").sortWithinPartitions("date", "symbol")
    out.write.option("partitionOverwriteMode", "dynamic").option("compression", "snappy").mode("overwrite").partitionBy("date").parquet(path)


def read_feature_matrix(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, columns: list[str] | None = None, target: str | None = None, least_quality: float | None = None) -> DataFrame:
    """Rows of a range of dates, with the asked columns and the target.

    Date bounds prune partitions and the columns reach the scan. A column that no
    file has is null. Rows without a target go, and with ``least_quality`` those
    whose ``data_quality_score`` is lower; a missing score counts as 1.
    """
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    if least_quality is not None and "data_quality_score" in rows.columns:
        rows = rows.where(F.coalesce("data_quality_score", F.lit(1.0)) >= least_quality)
    if target is not None:
        rows = rows.where(F.col(target).isNotNull())
    wanted = list(dict.fromkeys([*(columns or [c for c in rows.columns if c not in ("symbol", "date")]), *([target] if target else [])]))
    have = set(rows.columns)
    return rows.select("symbol", "date", *[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in wanted])
