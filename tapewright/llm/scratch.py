"""Intermediate tables in the folder that the whole cluster shares.

Multi-step operators cut their lineage by writing a table and reading it back.
The tables live under ``spark.checkpoint.dir``, so that they outlive the
executors that wrote them; a lost executor costs at most its running tasks.
Steps discard the tables that a later written one has replaced; what lazy results
still read stays until :func:`clear` removes it.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} is not set: it must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tapewright-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def write_table(df: DataFrame, label: str) -> str:
    """Write ``df`` as a new compressed table and return its path."""
    path = f"{shared_folder(df.sparkSession)}/tapewright/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    schema = df.schema
    path = write_table(df, label)
    table = df.sparkSession.read.schema(schema).parquet(path)
    _paths[table] = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for table in tables:
        if path := _paths.pop(table, None):
            _delete(table.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables in the shared folder, those of other runs too."""
    _delete(spark, f"{shared_folder(spark)}/tapewright")
