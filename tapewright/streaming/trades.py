"""Structured Streaming over trades: late-data rules, bars, footprints, tick direction."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def deduplicated(trades: DataFrame, key: str = "event_id", late: str = LATE) -> DataFrame:
    """Each trade once, by id, within the watermark; distinct trades of one instant all stay."""
    return trades.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def stream_bars(trades: DataFrame, length: str = "1 hour", late: str = LATE) -> DataFrame:
    """OHLCV bars of tumbling windows; prints of one instant are ordered by their id."""
    by = F.struct("ts", "event_id")
    out = deduplicated(trades, late=late).groupBy("symbol", F.window("ts", length).alias("w")).agg(
        F.min_by("price", by).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", by).alias("close"), F.sum("size").alias("volume"),
    )
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_footprint(trades: DataFrame, length: str = "1 hour", tick: float = 10.0, late: str = LATE) -> DataFrame:
    """Buy, sell and count per window and price bucket of trades that carry a ``direction``."""
    rows = trades.withWatermark("ts", late).withColumn("bucket", F.floor(F.col("price") / tick) * tick)
    out = rows.groupBy("symbol", F.window("ts", length).alias("w"), "bucket").agg(
        F.sum(F.when(F.col("direction") > 0, F.col("size")).otherwise(0)).alias("buy"), F.sum(F.when(F.col("direction") < 0, F.col("size")).otherwise(0)).alias("sell"), F.count(F.lit(1)).alias("n"),
    )
    return out.select("symbol", F.col("w.start").alias("bar"), "bucket", "buy", "sell", "n", (F.col("buy") - F.col("sell")).alias("delta"))


def stream_direction(trades: DataFrame, late: str = LATE) -> DataFrame:
    """Trades with their tick direction; a symbol's last price and direction are its state.

    Trades are taken in the order of time and id within a batch, and after those
    of earlier batches; a trade older than what the state has seen still gets a
    direction, from the state as it is.
    """

    def step(key, batches: Iterator, state: GroupState):
        import pandas as pd

        price, way = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        out = []
        for p in rows["price"]:
            way = way if price is None or p == price else 1 if p > price else -1
            out.append(way)
            price = p
        state.update((float(price), int(way)))
        yield rows.assign(direction=out)[["event_id", "symbol", "ts", "price", "size", "direction"]]

    schema = "event_id long, symbol string, ts timestamp, price double, size int, direction int"
    rows = trades.select("event_id", "symbol", F.col("ts").cast("timestamp").alias("ts"), "price", "size").withWatermark("ts", late)
    return rows.groupBy("symbol").applyInPandasWithState(step, schema, "price double, way int", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str, keys: list[str]):
    """A ``foreachBatch`` function: writes each batch to a place named by its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
