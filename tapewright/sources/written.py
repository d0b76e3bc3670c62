"""Tables that several steps read, written once to the folder that the whole cluster shares.

Reading a written table again cuts lineage, so a lost executor costs its running tasks,
and keeps later plans small: what has been written is a scan and not its whole history.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} is not set: it must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tapewright-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/tapewright/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a scan of what it was written to."""
    path = new_folder(df.sparkSession, label)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
