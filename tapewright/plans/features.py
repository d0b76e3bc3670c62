"""Queries over sources and daily features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import rounded
from ..operators import features as ops
from ..sources import tables
from .registry import BARS, HOURLY, W, WEEKLY, query, s_frame, s_full, s_lag, s_round


def _bars(spark, sf):
    """Adjusted daily bars; they are written once, so whatever reads them several times joins and groups the prints once."""
    return tables.adjust_bars(tables.daily_bars(spark, sf))


def _out(df, *columns, keys=("symbol", "ts"), digits=6):
    return df.select(*keys, *[rounded(F.col(c), digits).alias(c) for c in columns])


OHLCV = ("open", "high", "low", "close", "volume")


@query("daily_bars", f"WITH {BARS} SELECT symbol, ts, {', '.join(f'{s_round(c)} AS {c}' for c in OHLCV)} FROM raw_bars")
def _(spark, sf):
    return _out(tables.daily_bars(spark, sf), *OHLCV)


@query("weekly_bars", f"WITH {WEEKLY} SELECT symbol, ts, {', '.join(f'{s_round(c)} AS {c}' for c in OHLCV)} FROM weekly")
def _(spark, sf):
    return _out(tables.weekly_bars(spark, sf), *OHLCV)


@query("resample_ohlcv", f"WITH {HOURLY} SELECT symbol, ts, {', '.join(f'{s_round(c)} AS {c}' for c in OHLCV)} FROM hourly")
def _(spark, sf):
    return _out(tables.resample(tables.ticks(spark, sf)), *OHLCV)


@query("adjust_bars", f"WITH {BARS} SELECT symbol, ts, {', '.join(f'{s_round(c)} AS {c}' for c in OHLCV)} FROM bars")
def _(spark, sf):
    return _out(_bars(spark, sf), *OHLCV)


@query(
    "read_bars",
    f"WITH {BARS} SELECT symbol, ts, {s_round('close')} AS close FROM bars WHERE symbol IN ('1-URGENT', '2-HIGH') AND ts BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'",
)
def _(spark, sf):
    return _out(tables.read_bars(_bars(spark, sf), ["1-URGENT", "2-HIGH"], "1997-01-01", "1998-12-31"), "close")


_RET = ", ".join(f"CASE WHEN {s_lag('close', n)} > 0 AND close > 0 THEN {s_round(f'ln(close / {s_lag("close", n)})')} END AS return_{n}d" for n in ops.RETURNS)


@query("feature_returns", f"WITH {BARS} SELECT symbol, ts, {_RET}, {s_round(f'close / {s_lag("close", 10)} - 1')} AS roc_10 FROM bars")
def _(spark, sf):
    return _out(ops.returns(_bars(spark, sf)), *[f"return_{n}d" for n in ops.RETURNS], "roc_10")


_SMA = ", ".join(f"{s_full(n, 'avg(close)')} AS sma_{n}" for n in ops.AVERAGES)
_TREND = ", ".join(
    f"{s_round(f'sma_{n}')} AS sma_{n}, {s_round(f'd_{n}')} AS sma_distance_{n}, {s_round(f'CAST(close > sma_{n} AS INT)')} AS above_sma_{n}, "
    f"{s_round(f'd_{n} - {s_lag(f"d_{n}", 5)}')} AS sma_distance_momentum_{n}"
    for n in ops.AVERAGES
)


@query(
    "feature_trend",
    f"WITH {BARS}, a AS (SELECT *, {_SMA} FROM bars), d AS (SELECT *, {', '.join(f'close / sma_{n} - 1 AS d_{n}' for n in ops.AVERAGES)} FROM a) SELECT symbol, ts, {_TREND} FROM d",
)
def _(spark, sf):
    names = [f"{p}_{n}" for n in ops.AVERAGES for p in ("sma", "sma_distance", "above_sma", "sma_distance_momentum")]
    return _out(ops.trend(_bars(spark, sf)), *names)


@query(
    "feature_rsi_simple",
    f"""WITH {BARS}, d AS (SELECT *, close - {s_lag("close")} AS d FROM bars),
    g AS (SELECT *, count(d) OVER {s_frame(14)} AS n, avg(greatest(d, 0)) OVER {s_frame(14)} AS g, avg(greatest(-d, 0)) OVER {s_frame(14)} AS l FROM
          (SELECT symbol, ts, close, d FROM d)),
    r AS (SELECT symbol, ts, CASE WHEN n = 14 THEN CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END END AS rsi_14 FROM g)
    SELECT symbol, ts, {s_round("rsi_14")} AS rsi_14, {s_round(f"rsi_14 - {s_lag('rsi_14', 5)}")} AS rsi_momentum FROM r""",
)
def _(spark, sf):
    return _out(ops.rsi_simple(_bars(spark, sf)), "rsi_14", "rsi_momentum")


@query(
    "feature_volatility",
    f"""WITH {BARS}, b AS (SELECT *, {s_lag("close")} AS p FROM bars),
    t AS (SELECT symbol, ts, CASE WHEN p IS NOT NULL THEN greatest(high - low, abs(high - p), abs(low - p)) END AS tr, ln(close / p) AS r FROM b)
    SELECT symbol, ts, {s_round(f"CASE WHEN count(tr) OVER {s_frame(14)} = 14 THEN avg(tr) OVER {s_frame(14)} END")} AS atr_14,
    {", ".join(s_round(f"CASE WHEN count(r) OVER {s_frame(n)} = {n} THEN stddev_samp(r) OVER {s_frame(n)} * sqrt(252) END") + f" AS realized_vol_{n}" for n in (20, 60))} FROM t""",
)
def _(spark, sf):
    return _out(ops.volatility(_bars(spark, sf)), "atr_14", "realized_vol_20", "realized_vol_60")


@query(
    "feature_volume",
    f"""WITH {BARS} SELECT symbol, ts, {s_round(f"volume / ({s_full(20, 'avg(volume)', -1)})")} AS volume_ratio_20,
    round({s_full(20, "avg(close * volume)")}, 2) + 0.0 AS dollar_volume_20,
    {s_round(f"({s_full(5, 'avg(volume)')}) / ({s_full(5, 'avg(volume)', -5)}) - 1")} AS volume_trend_5 FROM bars""",
)
def _(spark, sf):
    out = ops.volume(_bars(spark, sf))
    return out.select("symbol", "ts", rounded(F.col("volume_ratio_20")).alias("volume_ratio_20"), rounded(F.col("dollar_volume_20"), 2).alias("dollar_volume_20"), rounded(F.col("volume_trend_5")).alias("volume_trend_5"))


_RS = lambda n: f"ln(close / {s_lag('close', n)}) - ln(b / {s_lag('b', n)})"
MARKET = "market AS (SELECT ts, avg(close) AS b FROM bars GROUP BY ts)"


@query(
    "feature_relative_strength",
    f"""WITH {BARS}, {MARKET}, j AS (SELECT * FROM bars JOIN market USING (ts)), r AS (SELECT symbol, ts, {", ".join(f"{_RS(n)} AS rs_{n}" for n in (20, 60, 120))} FROM j)
    SELECT symbol, ts, {", ".join(f"{s_round(f'rs_{n}')} AS rs_{n}" for n in (20, 60, 120))}, {s_round(f"rs_20 - {s_lag('rs_20', 5)}")} AS rs_momentum FROM r""",
)
def _(spark, sf):
    bars = _bars(spark, sf)
    return _out(ops.relative_strength(bars, ops.market_bar(bars)), "rs_20", "rs_60", "rs_120", "rs_momentum")


def _wma(n: int, c: str) -> str:
    return f"CASE WHEN count({c}) OVER {s_frame(n)} = {n} THEN list_sum(list_transform(list({c}) OVER {s_frame(n)}, lambda x, i: x * i)) / {n * (n + 1) / 2} END"


@query(
    "feature_hull",
    f"""WITH {BARS}, h AS (SELECT *, 2 * ({_wma(43, "close")}) - ({_wma(87, "close")}) AS h FROM bars), m AS (SELECT *, {_wma(9, "h")} AS m FROM h)
    SELECT symbol, ts, {s_round("m")} AS hma_87, {s_round("close / m - 1")} AS hma_87_distance, {s_round("CAST(close > m AS INT)")} AS hma_87_above FROM m""",
)
def _(spark, sf):
    return _out(ops.hull(_bars(spark, sf)), "hma_87", "hma_87_distance", "hma_87_above")


@query(
    "market_regime",
    f"""WITH {BARS}, {MARKET}, m AS (SELECT 'market' AS symbol, ts, b AS close FROM market),
    a AS (SELECT *, {s_full(50, "avg(close)")} AS a50, {s_full(200, "avg(close)")} AS a200, ln(close / {s_lag("close", 20)}) AS r FROM m)
    SELECT ts, {s_round("CAST(close > a50 AS INT)")} AS above_50, {s_round("CAST(close > a200 AS INT)")} AS above_200, {s_round("r")} AS return_20d,
    CASE WHEN close > a50 AND close > a200 THEN 1 WHEN close <= a50 AND close <= a200 THEN -1 ELSE 0 END AS trend FROM a""",
)
def _(spark, sf):
    out = ops.market_regime(ops.market_bar(_bars(spark, sf)))
    return out.select("ts", "above_50", "above_200", rounded(F.col("return_20d")).alias("return_20d"), "trend")


_SEC = ", ".join(f"close / {s_lag('close', n)} - 1 AS r{n}" for n in (5, 20, 60))
_SECB = ", ".join(f"b / lag(b, {n}) OVER (ORDER BY ts) - 1 AS b{n}" for n in (5, 20, 60))


@query(
    "sector_strength",
    f"""WITH {WEEKLY}, market AS (SELECT ts, avg(close) AS b FROM weekly GROUP BY ts), mb AS (SELECT ts, {_SECB} FROM market),
    s AS (SELECT symbol, ts, {_SEC} FROM weekly), j AS (SELECT symbol, ts, r5 - b5 AS rs_5d, r20 - b20 AS rs_20d, r60 - b60 AS rs_60d FROM s JOIN mb USING (ts)),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY ts ORDER BY coalesce(rs_20d, -999) DESC, symbol) AS INT) AS rank_20d, count(*) OVER (PARTITION BY ts) AS n FROM j)
    SELECT symbol, ts, {", ".join(f"{s_round(f'rs_{n}d')} AS rs_{n}d" for n in (5, 20, 60))}, rank_20d, rank_20d <= 3 AS leading, rank_20d > n - 3 AS lagging FROM k""",
)
def _(spark, sf):
    bars = tables.weekly_bars(spark, sf)
    out = ops.sector_strength(bars, ops.market_bar(bars))
    return out.select("symbol", "ts", *[rounded(F.col(f"rs_{n}d")).alias(f"rs_{n}d") for n in (5, 20, 60)], "rank_20d", "leading", "lagging")


@query("latest_dates", f"WITH {BARS} SELECT symbol, max(ts) AS latest, count(*) AS n_bars, {s_round('arg_max(close, ts)')} AS last_close FROM bars GROUP BY symbol")
def _(spark, sf):
    out = _bars(spark, sf).groupBy("symbol").agg(F.max("ts").alias("latest"), F.count(F.lit(1)).alias("n_bars"), F.max_by("close", "ts").alias("last_close"))
    return out.withColumn("last_close", rounded(F.col("last_close")))
