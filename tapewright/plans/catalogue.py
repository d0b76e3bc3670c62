"""Queries over conditions by name and over one specification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import catalogue as ops
from .features import _bars, _out
from .patterns import PATTERNS
from .recursive import REC
from .registry import BARS, W, query, s_lead, s_round

_UP = lambda v: f"close - {v} > 0 AND lag(close - {v}) OVER ({W}) <= 0"
_DOWN = lambda v: f"close - {v} < 0 AND lag(close - {v}) OVER ({W}) >= 0"
_N = lambda rule: f"sum(CASE WHEN {rule} THEN 1 ELSE 0 END) OVER ({W} ROWS 2 PRECEDING) = 3"
#: Column name: condition, its parameters, and the rule in SQL.
_NAMED = {
    "oversold_rsi": ("oversold_rsi", {}, "rsi <= 30"), "overbought_rsi": ("overbought_rsi", {}, "rsi >= 70"),
    "omni_cross_up": ("omni_cross_up", {"period": 50}, _UP("e50")), "omni_cross_down": ("omni_cross_down", {"period": 50}, _DOWN("e50")),
    "omni_green_nd": ("omni_green_nd", {"period": 50}, _N("close > e50")), "omni_red_nd": ("omni_red_nd", {"period": 50}, _N("close < e50")),
    "ema_lows_cross_up": ("ema_lows_cross_up", {}, _UP("l82")), "ema_lows_cross_down": ("ema_lows_cross_down", {}, _DOWN("l82")), "ema_lows_above_nd": ("ema_lows_above_nd", {}, _N("close > l82")),
    "ema_lows_support": ("ema_lows_support", {}, "abs(low / l82 - 1) <= 0.005 AND close > l82 AND close > open"), "ema_lows_green_slope": ("ema_lows_green_slope", {}, f"close > l82 AND l82 > lag(l82, 5) OVER ({W})"),
    "oscar_cross_up": ("oscar_cross_up", {}, f"st - 50 > 0 AND lag(st - 50) OVER ({W}) <= 0"), "oscar_cross_down": ("oscar_cross_down", {}, f"st - 50 < 0 AND lag(st - 50) OVER ({W}) >= 0"), "oscar_above_50": ("oscar_above_50", {}, "st > 50"),
}


@query("conditions_by_name", f"WITH RECURSIVE {REC} SELECT symbol, ts, {', '.join(f'coalesce({r}, false) AS {n}' for n, (_, _, r) in _NAMED.items())} FROM ri")
def _(spark, sf):
    bars = _bars(spark, sf).select("symbol", "ts", "open", "high", "low", "close", "volume")
    parts = [ops.evaluate(bars, c, **p).select("symbol", "ts", F.col("signal").alias(n)) for n, (c, p, _) in _NAMED.items()]
    return reduce(lambda a, b: a.join(b, ["symbol", "ts"]), parts)


_WMA = lambda n, x: f"CASE WHEN count({x}) OVER ({W} ROWS {n - 1} PRECEDING) = {n} THEN list_sum(list_transform(list_zip(list({x}) OVER ({W} ROWS {n - 1} PRECEDING), range(1, {n + 1})), lambda z: z[1] * z[2])) / {n * (n + 1) / 2} END"


@query(
    "hull_crosses",
    f"""WITH {BARS}, h0 AS (SELECT symbol, ts, close, 2 * {_WMA(10, "close")} - {_WMA(21, "close")} AS h FROM bars), h1 AS (SELECT *, {_WMA(5, "h")} AS v FROM h0)
    SELECT symbol, ts, coalesce({_UP("v")}, false) AS cross_up, coalesce({_DOWN("v")}, false) AS cross_down FROM h1""",
)
def _(spark, sf):
    bars = _bars(spark, sf)
    up, down = (ops.evaluate(bars, f"hma_cross_{x}", period=21).select("symbol", "ts", F.col("signal").alias(f"cross_{x}")) for x in ("up", "down"))
    return up.join(down, ["symbol", "ts"])


@query(
    "spec_runner",
    f"""WITH {PATTERNS}, f AS (SELECT p.*, year(p.ts) AS yr, {", ".join(f"-({s_lead('p.close', h).replace('symbol', 'p.symbol').replace('ORDER BY ts', 'ORDER BY p.ts')} / p.close - 1) * 100 AS x{h}" for h in (1, 5, 10))} FROM pat p),
    l AS ({" UNION ALL ".join(f"SELECT {h} AS horizon, yr, x{h} AS r FROM f WHERE engulfing_bear AND x{h} IS NOT NULL" for h in (1, 5, 10))})
    SELECT horizon, CAST(yr AS INT) AS year, count(*) AS n, {s_round("avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END)")} AS hit_rate, {s_round("avg(r)")} AS mean FROM l GROUP BY GROUPING SETS ((horizon, yr), (horizon))""",
)
def _(spark, sf):
    found = ops.spec_runner(_bars(spark, sf), {"condition": "candle", "params": {"pattern": "bearish_engulfing"}, "direction": "short"})
    return _out(found, "hit_rate", "mean", keys=("horizon", "year", "n"))
