"""Replaying files as a stream gives what the batch operators give."""

import time

from pyspark.sql import functions as F

from tapewright.operators import intraday
from tapewright.sources import tables
from tapewright.streaming import trades as streaming

FOLDER = "/root/testdata/sf0.001"


def replay(spark, path, make):
    batch = tables.ticks(spark, FOLDER).where("ts < timestamp_ntz'2024-01-10 00:00:00'").withColumn("ts", F.col("ts").cast("timestamp"))
    for first, last in ((1, 3), (4, 5), (6, 7), (8, 9)):  # one file after another, as they would arrive
        batch.where(F.dayofmonth("ts").between(first, last)).coalesce(1).write.mode("append").parquet(f"{path}/in")
        time.sleep(1.1)
    rows = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    run = make(rows).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return batch, spark.table("out")


def test_bars(spark, tmp_path):
    batch, out = replay(spark, tmp_path, lambda s: streaming.stream_bars(s, late="0 seconds"))
    want = {(r["symbol"], str(r["ts"])): tuple(r)[2:] for r in tables.resample(batch).select("symbol", "ts", "open", "high", "low", "close", "volume").collect()}
    got = {(r["symbol"], str(r["ts"])): tuple(r)[2:] for r in out.collect()}
    assert len(got) > 100
    assert all(want[k] == v for k, v in got.items())


def test_direction(spark, tmp_path):
    batch, out = replay(spark, tmp_path, streaming.stream_direction)
    want = {r["event_id"]: r["direction"] for r in intraday.tick_direction(batch).collect()}
    assert {r["event_id"]: r["direction"] for r in out.collect()} == want
