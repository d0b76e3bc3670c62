"""Trade templates, liquidity and size sweeps, outcome groups, text chunks and tests of extracted conditions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.windows import ahead, lead
from .conditions import masks
from .outcomes import forward_returns, path_stats

HORIZONS = (1, 3, 6, 12, 24)


def signals_per_day(trades: DataFrame) -> DataFrame:
    """Trades by entry date, and by side."""
    return trades.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("direction") > 0).alias("n_long"), F.count_if(F.col("direction") < 0).alias("n_short"))


def liquidity_sweep(trades: DataFrame, bars: DataFrame, filters: dict[str, Column], ret: str = "ret_5") -> DataFrame:
    """Metrics of trades in symbols that pass each filter on mean ``volume`` and ``turnover``."""
    liquid = bars.groupBy("symbol").agg(F.avg("volume").alias("volume"), F.avg(F.col("close") * F.col("volume")).alias("turnover"))
    rows = trades.select("symbol", F.col(ret).alias("_r")).join(liquid, "symbol")
    items = F.array(*[F.struct(F.lit(n).alias("filter"), c.alias("on")) for n, c in filters.items()])
    long = rows.select("_r", F.inline(items)).where("on")
    return long.groupBy("filter").agg(F.count(F.lit(1)).alias("n"), F.avg("_r").alias("expectancy"), F.avg((F.col("_r") > 0).cast("int")).alias("win_rate"))


def size_positions(trades: DataFrame, dollars: Iterable[float] = (1_000.0, 10_000.0), risk: float = 100.0, ret: str = "ret_5") -> DataFrame:
    """Profit under fixed sizes and under fixed risk of ``risk / (1.5 ATR %)``; ATR has the mean where missing and a floor."""
    mean = trades.agg(F.avg("atr_pct").alias("_mean"))
    rows = trades.join(F.broadcast(mean)).withColumn("_atr", F.greatest(F.coalesce("atr_pct", "_mean"), F.lit(0.5)))
    rules = {f"fixed_{int(d)}": F.lit(float(d)) for d in dollars} | {"fixed_risk": risk / (1.5 * F.col("_atr") / 100)}
    long = rows.select(F.col(ret).alias("_r"), F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("size")) for n, c in rules.items()])))
    profit = F.col("size") * F.col("_r") / 100
    return long.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum(profit).alias("profit"), F.avg("size").alias("mean_size"), F.min(profit).alias("worst"))


def group_outcomes(rows: DataFrame, group: str, horizons: Iterable[int] = (1, 5, 10)) -> DataFrame:
    """Hit rate, mean and median at every horizon and the mean path, by one column."""
    out = [F.count(F.lit(1)).alias("n"), F.avg("max_runup_20d").alias("runup"), F.avg("max_drawdown_20d").alias("drawdown")]
    for h in horizons:
        c = f"fwd_{h}d"
        out += [F.avg(F.when(F.col(c).isNotNull(), (F.col(c) > 0).cast("int"))).alias(f"hit_{h}"), F.avg(c).alias(f"mean_{h}"), F.percentile(c, F.lit(0.5)).alias(f"median_{h}")]
    return rows.groupBy(group).agg(*out)


def outcomes_of(bars: DataFrame) -> DataFrame:
    return path_stats(forward_returns(bars, (1, 5, 10)), (20,))


def pattern_event_outcomes(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Fired patterns (``symbol, ts, pattern, bias``) with later returns, next-bar excursions and a 1 % target or stop by bias."""
    over = ahead(1, 1)
    rows = bars.select("symbol", "ts", "close", *[((lead("close", h) / F.col("close") - 1) * 100).alias(f"ret_{h}") for h in HORIZONS], ((F.max("high").over(over) / F.col("close") - 1) * 100).alias("_up"), ((F.min("low").over(over) / F.col("close") - 1) * 100).alias("_down"))
    out = events.join(rows, ["symbol", "ts"])
    up, down = F.col("_up"), F.col("_down")
    bull, bear = F.col("bias") == "bullish", F.col("bias") == "bearish"
    return out.withColumns(
        {
            "mfe": F.when(bull, up).when(bear, -down),
            "mae": F.when(bull, down).when(bear, -up),
            "target_hit": F.when(bull, up >= 1).when(bear, down <= -1),
            "stop_hit": F.when(bull, down <= -1).when(bear, up >= 1),
        }
    ).drop("_up", "_down", "close")


def chunk_places(text: str, size: int = 1500, overlap: int = 200, slack: int = 100) -> list[tuple[int, int]]:
    """Overlapping spans of a text, each cut at a paragraph or sentence end within the slack; ends with the text."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            for mark in ("\n\n", ". ", "! ", "? "):
                at = text.rfind(mark, max(start + overlap + 1, end - slack), end)
                if at > 0:
                    end = at + len(mark)
                    break
        out.append((start, end))
        if end == len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def chunk_text(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1500, overlap: int = 200, slack: int = 100) -> DataFrame:
    """``<key>, chunk, start, text`` for each span of every document; null texts have none."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = [(k, i, a, t[a:b]) for k, t in zip(frame["key"], frame["text"], strict=True) if t for i, (a, b) in enumerate(chunk_places(t, size, overlap, slack))]
            yield pd.DataFrame(rows, columns=[key, "chunk", "start", "text"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, chunk int, start int, text string")


def test_hypotheses(found: DataFrame, bars: DataFrame, specs: dict[tuple[str, float], tuple[str, dict]], horizon: int = 5) -> DataFrame:
    """Extracted conditions joined to what followed them: how often stated, events, hit rate, mean.

    ``specs`` has the masks of the distinct (condition, value) pairs to test; all
    are columns of one plan over the bars.
    """
    names = {f"_h{i}": key for i, key in enumerate(specs)}
    rows = forward_returns(masks(bars, {n: specs[k] for n, k in names.items()}), [horizon]).where(F.col(f"fwd_{horizon}d").isNotNull())
    items = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(float(v)).alias("value"), F.col(n).alias("on")) for n, (c, v) in names.items()])
    stats = rows.select(F.col(f"fwd_{horizon}d").alias("_r"), F.inline(items)).where("on").groupBy("condition", "value")
    stats = stats.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_r") > 0).cast("int")).alias("hit_rate"), F.avg("_r").alias("mean"))
    stated = found.groupBy("condition", "value").agg(F.count(F.lit(1)).alias("n_stated"))
    return stated.join(stats, ["condition", "value"])
