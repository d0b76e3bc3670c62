"""Queries over recursive indicators; their SQL is a recursive query over each symbol's bar numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.recurrences import Indicator, with_indicators
from ..functions.windows import rounded
from ..operators import outcomes, recursive as ops
from ..sources import tables
from .features import _bars, _out
from .registry import BARS, HOURLY, W, query, s_full, s_lag, s_lead, s_round


def _sma(name: str, n: int, seed: str, x: str) -> str:
    """An exponential mean that starts at bar ``n`` with the mean of the first ``n`` values."""
    return f"CASE WHEN b.k < {n} THEN NULL WHEN b.k = {n} THEN b.{seed} ELSE {2 / (n + 1)!r} * b.{x} + {1 - 2 / (n + 1)!r} * e.{name} END"


def _first(name: str, n: int, x: str) -> str:
    return f"{2 / (n + 1)!r} * b.{x} + {1 - 2 / (n + 1)!r} * e.{name}"


_SEEDS = {"e9": (9, "close"), "e20": (20, "close"), "e50": (50, "close"), "m12": (12, "close"), "m26": (26, "close"), "l20": (20, "low"), "l50": (50, "low"), "l82": (82, "low")}
_D = 50
_NEXT = {n: _sma(n, k, f"s_{n}", x) for n, (k, x) in _SEEDS.items()}
_NEXT |= {
    "f9": _first("f9", 9, "close"),
    "g": "CASE WHEN b.k < 15 THEN NULL WHEN b.k = 15 THEN b.s_g ELSE (e.g * 13 + greatest(b.d, 0)) / 14 END",
    "l": "CASE WHEN b.k < 15 THEN NULL WHEN b.k = 15 THEN b.s_l ELSE (e.l * 13 + greatest(-b.d, 0)) / 14 END",
    "st": "CASE WHEN b.k < 87 THEN NULL WHEN b.k = 87 THEN b.raw ELSE 2.0 / 3 * e.st + b.raw / 3 END",
}
_STEP = {
    # A mean of a mean starts once so many values of the first are known: their running sum is carried.
    "a20": "CASE WHEN b.k BETWEEN 20 AND 38 THEN coalesce(e.a20, 0) + n.e20 END",
    "dd20": f"CASE WHEN b.k < 39 THEN NULL WHEN b.k = 39 THEN (e.a20 + n.e20) / 20 ELSE {2 / 21!r} * n.e20 + {1 - 2 / 21!r} * e.dd20 END",
    "al50": "CASE WHEN b.k BETWEEN 50 AND 98 THEN coalesce(e.al50, 0) + n.l50 END",
    "dl50": f"CASE WHEN b.k < 99 THEN NULL WHEN b.k = 99 THEN (e.al50 + n.l50) / 50 ELSE {2 / 51!r} * n.l50 + {1 - 2 / 51!r} * e.dl50 END",
    "am": "CASE WHEN b.k BETWEEN 26 AND 33 THEN coalesce(e.am, 0) + (n.m12 - n.m26) END",
    "sg": f"CASE WHEN b.k < 34 THEN NULL WHEN b.k = 34 THEN (e.am + n.m12 - n.m26) / 9 ELSE {2 / 10!r} * (n.m12 - n.m26) + {1 - 2 / 10!r} * e.sg END",
}
_ALL = [*_NEXT, *_STEP]
REC = f"""{BARS},
    r0 AS (SELECT symbol, ts, open, high, low, close, volume, close - {s_lag("close")} AS d, row_number() OVER ({W}) AS k FROM bars),
    rb AS (
        SELECT *, {", ".join(f"CASE WHEN k = {k} THEN avg({x}) OVER ({W} ROWS {k - 1} PRECEDING) END AS s_{n}" for n, (k, x) in _SEEDS.items())},
               CASE WHEN k = 15 THEN avg(greatest(d, 0)) OVER ({W} ROWS 13 PRECEDING) END AS s_g, CASE WHEN k = 15 THEN avg(greatest(-d, 0)) OVER ({W} ROWS 13 PRECEDING) END AS s_l,
               CASE WHEN {s_full(87, "max(high)")} = {s_full(87, "min(low)")} THEN 50.0 ELSE (close - {s_full(87, "min(low)")}) / ({s_full(87, "max(high)")} - {s_full(87, "min(low)")}) * 100 END AS raw
        FROM r0),
    rec AS (
        SELECT symbol, k, {", ".join(f"CAST({'close' if n == 'f9' else 'NULL'} AS DOUBLE) AS {n}" for n in _ALL)} FROM rb WHERE k = 1
        UNION ALL
        SELECT n.symbol, n.k, {", ".join(f"n.{c}" for c in _NEXT)}, {", ".join(x.replace("b.k", "n.k").replace("e.", "n.p_") for x in _STEP.values())}
        FROM (SELECT b.symbol, b.k, {", ".join(f"{x} AS {n}" for n, x in _NEXT.items())}, {", ".join(f"e.{n} AS p_{n}" for n in _STEP)} FROM rec e JOIN rb b ON b.symbol = e.symbol AND b.k = e.k + 1) n),
    ri AS (
        SELECT rb.*, {", ".join(f"rec.{n}" for n in _ALL)}, 2 * e20 - dd20 AS dema_20, 2 * l50 - dl50 AS dema_l50, CASE WHEN rb.k >= 35 THEN m12 - m26 - sg END AS macd,
               CASE WHEN rb.k >= 16 THEN CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END END AS rsi
        FROM rb JOIN rec USING (symbol, k))"""
_CROSS = lambda above, up: f"coalesce({'' if up else 'NOT '}({above}) AND {'NOT ' if up else ''}lag({above}) OVER ({W}), false)"


@query("ema", f"WITH RECURSIVE {REC} SELECT symbol, ts, {s_round('e20', 4)} AS ema_20, {s_round('f9', 4)} AS ema_9, {s_round('l82', 4)} AS low_ema_82 FROM ri")
def _(spark, sf):
    specs = [Indicator("ema_20", "ema", 20), Indicator("ema_9", "ema", 9, seed="first"), Indicator("low_ema_82", "ema", 82, "low")]
    return _out(with_indicators(_bars(spark, sf), specs), "ema_20", "ema_9", "low_ema_82", digits=4)


@query("recursive_indicators", f"WITH RECURSIVE {REC} SELECT symbol, ts, {s_round('dema_20', 4)} AS dema_20, {s_round('rsi', 4)} AS rsi_wilder_14, {s_round('macd', 4)} AS macd_histogram, {s_round('st', 4)} AS stoch_87 FROM ri")
def _(spark, sf):
    specs = [Indicator("dema_20", "dema", 20), Indicator("rsi_wilder_14", "rsi", 14), Indicator("macd_histogram", "macd"), Indicator("stoch_87", "stochastic", 87)]
    return _out(with_indicators(_bars(spark, sf), specs), *[s.name for s in specs], digits=4)


_LOW = f"{REC}, lw AS (SELECT *, CAST(close > l82 AS DOUBLE) AS above, close / l82 - 1 AS distance, l82 / lag(l82, 5) OVER ({W}) - 1 AS slope5, l82 / lag(l82, 10) OVER ({W}) - 1 AS slope10, CAST(abs(low / l82 - 1) <= 0.005 AND close > open AS DOUBLE) AS bounce FROM ri)"


@query(
    "low_ema_features",
    f"""WITH RECURSIVE {_LOW} SELECT symbol, ts, {s_round("l82")} AS low_ema_82, {s_round("above")} AS low_ema_82_above, {s_round("distance")} AS low_ema_82_distance, {s_round("slope5")} AS low_ema_82_slope_5,
    {s_round("slope10")} AS low_ema_82_slope_10, {s_round(f"distance - lag(distance, 5) OVER ({W})")} AS low_ema_82_distance_5, {s_round("bounce")} AS low_ema_82_bounce FROM lw""",
)
def _(spark, sf):
    names = [f"low_ema_82{s}" for s in ("", "_above", "_distance", "_slope_5", "_slope_10", "_distance_5", "_bounce")]
    return _out(ops.low_ema_features(_bars(spark, sf)), *names)


@query("stochastic_features", f"WITH RECURSIVE {REC} SELECT symbol, ts, {s_round('st', 4)} AS stoch_87, CAST(st > 50 AS DOUBLE) AS stoch_87_above_50 FROM ri")
def _(spark, sf):
    return _out(ops.stochastic_features(_bars(spark, sf)), "stoch_87", "stoch_87_above_50", digits=4)


@query("tier_adjusted_signal", f"WITH RECURSIVE {_LOW}, t AS (SELECT symbol, ts, above, 1 + k % 4 AS tier FROM lw) SELECT symbol, ts, tier, CAST(CASE WHEN above IS NULL AND tier <> 3 THEN NULL WHEN tier = 3 THEN 0 WHEN tier = 4 THEN 1 - 2 * above ELSE 2 * above - 1 END AS INT) AS signal FROM t")
def _(spark, sf):
    from ..functions.windows import by_symbol

    rows = ops.low_ema_features(_bars(spark, sf)).withColumn("tier", 1 + F.row_number().over(by_symbol()) % 4)
    return rows.select("symbol", "ts", "tier", ops.tier_adjusted_signal(F.col("low_ema_82_above"), F.col("tier")).cast("int").alias("signal"))


@query(
    "oscillator_masks",
    f"WITH RECURSIVE {REC} SELECT symbol, ts, coalesce(rsi < 30, false) AS oversold, coalesce(rsi > 70, false) AS overbought, {_CROSS('macd > 0', True)} AS macd_cross_up, {_CROSS('macd > 0', False)} AS macd_cross_down FROM ri",
)
def _(spark, sf):
    return ops.oscillator_masks(_bars(spark, sf)).select("symbol", "ts", "oversold", "overbought", "macd_cross_up", "macd_cross_down")


@query(
    "average_masks",
    f"""WITH RECURSIVE {REC} SELECT symbol, ts, {_CROSS("close > l82", True)} AS cross_up, {_CROSS("close > l82", False)} AS cross_down,
    sum(CASE WHEN close > l82 THEN 1 ELSE 0 END) OVER ({W} ROWS 2 PRECEDING) = 3 AS above_nd, coalesce(abs(low / l82 - 1) <= 0.005 AND close > l82 AND close > open, false) AS support FROM ri""",
)
def _(spark, sf):
    return ops.average_masks(_bars(spark, sf)).select("symbol", "ts", "cross_up", "cross_down", "above_nd", "support")


_FIT = {"ema_20": "l20", "ema_50": "l50", "ema_82": "l82", "dema_50": "dema_l50"}


@query(
    "indicator_fit",
    f"""WITH RECURSIVE {REC}, l AS ({" UNION ALL ".join(f"SELECT '{n}' AS indicator, {c} AS v, low, high, close FROM ri WHERE {c} IS NOT NULL" for n, c in _FIT.items())})
    SELECT indicator, count(*) AS n, {s_round("100 * avg(CASE WHEN v >= low THEN 1.0 ELSE 0.0 END)")} AS at_or_above_low, {s_round("100 * avg(CASE WHEN v BETWEEN low AND high THEN 1.0 ELSE 0.0 END)")} AS inside,
           {s_round("avg(abs(close / v - 1) * 100)")} AS mean_distance, {s_round("100 * avg(CASE WHEN close < v THEN 1.0 ELSE 0.0 END)")} AS closes_below FROM l GROUP BY indicator""",
)
def _(spark, sf):
    specs = [Indicator(f"ema_{n}", "ema", n, "low") for n in (20, 50, 82)] + [Indicator("dema_50", "dema", 50, "low")]
    return _out(ops.indicator_fit(_bars(spark, sf), specs), "at_or_above_low", "inside", "mean_distance", "closes_below", keys=("indicator", "n"))


_UNIT = lambda x: f"least(greatest({x}, 0), 1)"
_BEHAVIORS = {
    "gap_up": ("jump > 0.02", _UNIT("jump * 10")), "gap_down": ("jump < -0.02", _UNIT("-jump * 10")),
    "ema_stack_up": ("e9 > e20 AND e20 > e50", _UNIT("(e9 / e50 - 1) * 10")), "ema_stack_down": ("e9 < e20 AND e20 < e50", _UNIT("(1 - e9 / e50) * 10")),
    "rsi_reclaim": ("rsi > 30 AND p_rsi <= 30", _UNIT("(rsi - 30) / 20")), "rsi_overbought": ("rsi > 70", _UNIT("(rsi - 70) / 30")),
    "macd_cross_up": ("macd > 0 AND p_macd <= 0", "1.0"), "macd_cross_down": ("macd < 0 AND p_macd >= 0", "1.0"),
    "volume_surge": ("volume > 1.5 * mv", _UNIT("volume / mv / 5")), "inside_day": ("high < p_high AND low > p_low", "1.0"),
}
_BEH = f"""{REC}, bx AS (SELECT *, open / {s_lag("close")} - 1 AS jump, {s_lag("rsi")} AS p_rsi, {s_lag("macd")} AS p_macd, {s_lag("high")} AS p_high, {s_lag("low")} AS p_low,
        avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mv, {s_lead("close", 5)} / close - 1 AS later, {", ".join(f"({s_lead('close', h)} / close - 1) * 100 AS x{h}" for h in (1, 5, 10))} FROM ri),
    be AS ({" UNION ALL ".join(f"SELECT symbol, ts, '{n}' AS behavior, CAST({v} AS DOUBLE) AS intensity, later, x1, x5, x10 FROM bx WHERE {r}" for n, (r, v) in _BEHAVIORS.items())})"""


@query("behaviors", f"WITH RECURSIVE {_BEH} SELECT symbol, ts, behavior, {s_round('intensity')} AS intensity FROM be WHERE intensity IS NOT NULL")
def _(spark, sf):
    return _out(ops.candle_behaviors(_bars(spark, sf)), "intensity", keys=("symbol", "ts", "behavior"))


@query(
    "behavior_stats",
    f"""WITH RECURSIVE {_BEH}, l AS ({" UNION ALL ".join(f"SELECT behavior, {h} AS horizon, x{h} AS r FROM be WHERE x{h} IS NOT NULL AND intensity IS NOT NULL" for h in (1, 5, 10))})
    SELECT behavior, horizon, count(*) AS n, {s_round("avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END)")} AS hit_rate, {s_round("avg(r)")} AS mean, {s_round("CASE WHEN count(*) > 1 THEN stddev_samp(r) END")} AS std,
           {s_round("CASE WHEN coalesce(-sum(r) FILTER (r <= 0), 0) > 0 THEN least(coalesce(sum(r) FILTER (r > 0), 0) / -sum(r) FILTER (r <= 0), 99) ELSE 99 END")} AS profit_factor FROM l GROUP BY behavior, horizon""",
)
def _(spark, sf):
    bars = _bars(spark, sf)
    return _out(ops.behavior_stats(ops.candle_behaviors(bars), bars), "hit_rate", "mean", "std", "profit_factor", keys=("behavior", "horizon", "n"))


@query(
    "behavior_interactions",
    f"""WITH RECURSIVE {_BEH}, h AS (SELECT symbol, ts, behavior, CASE WHEN later > 0 THEN 1.0 ELSE 0.0 END AS hit FROM be WHERE later IS NOT NULL AND intensity IS NOT NULL), al AS (SELECT behavior, avg(hit) AS p FROM h GROUP BY behavior),
    pr AS (SELECT x.behavior AS a, y.behavior AS b, count(*) AS n, avg(x.hit) AS p FROM h x JOIN h y ON x.symbol = y.symbol AND x.ts = y.ts AND x.behavior < y.behavior GROUP BY 1, 2 HAVING count(*) >= 10)
    SELECT a, b, n, {s_round("pr.p")} AS hit_rate, {s_round("q.p")} AS hit_a, {s_round("r.p")} AS hit_b, {s_round("pr.p - q.p")} AS lift_a, {s_round("pr.p - r.p")} AS lift_b FROM pr JOIN al q ON a = q.behavior JOIN al r ON b = r.behavior""",
)
def _(spark, sf):
    bars = _bars(spark, sf)
    later = bars.select("symbol", "ts", outcomes.forward_return(5).alias("ret"))
    return _out(ops.behavior_interactions(ops.candle_behaviors(bars), later), "hit_rate", "hit_a", "hit_b", "lift_a", "lift_b", keys=("a", "b", "n"))


_EW = {"ema9": (9, "close"), "ema20": (20, "close"), "ema50": (50, "close"), "m12": (12, "close"), "m26": (26, "close"), "g": (14, "up"), "l": (14, "down"), "atr14": (14, "tr")}
_SIGNAL = f"{2 / 10!r} * (n.m12 - n.m26) + {1 - 2 / 10!r} * n.p_sig"
_MOM = f"""{HOURLY}, h0 AS (SELECT *, close - {s_lag("close")} AS d, {s_lag("close")} AS p, row_number() OVER ({W}) AS k FROM hourly),
    rb AS (SELECT *, coalesce(greatest(d, 0), 0) AS up, coalesce(greatest(-d, 0), 0) AS down, greatest(high - low, coalesce(abs(high - p), 0), coalesce(abs(low - p), 0)) AS tr FROM h0),
    rec AS (
        SELECT symbol, k, {", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, (_, x) in _EW.items())}, CAST(0 AS DOUBLE) AS sig FROM rb WHERE k = 1
        UNION ALL
        SELECT n.symbol, n.k, {", ".join(f"n.{c}" for c in _EW)}, {_SIGNAL}
        FROM (SELECT b.symbol, b.k, {", ".join(f"{_first(n, k, x)} AS {n}" for n, (k, x) in _EW.items())}, e.sig AS p_sig FROM rec e JOIN rb b ON b.symbol = e.symbol AND b.k = e.k + 1) n),
    m0 AS (SELECT rb.symbol, ts, k, close, ema9, ema20, ema50, atr14, m12 - m26 AS macd, round(m12 - m26 - sig, 9) AS side, m12 - m26 - sig AS hist, CASE WHEN k > 1 AND l <> 0 THEN 100 - 100 / (1 + g / l) END AS rsi FROM rb JOIN rec USING (symbol, k)),
    mo AS (SELECT *, lag(rsi) OVER ({W}) AS p_rsi, lag(side) OVER ({W}) AS p_side, ema9 - lag(ema9, 3) OVER ({W}) AS s9, ema20 - lag(ema20, 3) OVER ({W}) AS s20, CASE WHEN k >= 20 THEN avg(atr14) OVER ({W} ROWS 19 PRECEDING) END AS am FROM m0)"""
_MN = ("ema9", "ema20", "ema50", "ema9_slope", "ema20_slope", "rsi14", "macd", "macd_hist", "atr14")
_MB = ("rsi_reclaim_bull", "rsi_reclaim_bear", "macd_bull_cross", "macd_bear_cross", "compressed")


@query(
    "intraday_momentum",
    f"""WITH RECURSIVE {_MOM} SELECT symbol, ts, {", ".join(f"{s_round(c, 4)} AS {n}" for n, c in zip(_MN, ("ema9", "ema20", "ema50", "s9", "s20", "rsi", "macd", "hist", "atr14"), strict=True))},
    coalesce(rsi >= 40 AND p_rsi < 35, false) AS rsi_reclaim_bull, coalesce(rsi <= 60 AND p_rsi > 65, false) AS rsi_reclaim_bear, coalesce(side > 0 AND p_side <= 0, false) AS macd_bull_cross,
    coalesce(side < 0 AND p_side >= 0, false) AS macd_bear_cross, coalesce(atr14 < 0.75 * am, false) AS compressed FROM mo""",
)
def _(spark, sf):
    out = ops.momentum_features(tables.hourly_bars(spark, sf))
    return out.select("symbol", "ts", *[rounded(F.col(c), 4).alias(c) for c in _MN], *_MB)


@query(
    "compare_indicators",
    f"""WITH RECURSIVE {REC}, cx AS (SELECT *, {s_lead("close", 5)} AS later, {", ".join(f"coalesce(close > {c} AND NOT lag(close > {c}) OVER ({W}), false) AS up_{c}" for c in _FIT.values())} FROM ri),
    l AS ({" UNION ALL ".join(f"SELECT '{n}' AS indicator, {c} AS v, low, high, close FROM ri WHERE {c} IS NOT NULL" for n, c in _FIT.items())}),
    f AS (SELECT indicator, count(*) AS n, avg(abs(close / v - 1) * 100) AS mean_distance FROM l GROUP BY indicator),
    u AS ({" UNION ALL ".join(f"SELECT '{n}' AS indicator, ln(later / close) AS r FROM cx WHERE later IS NOT NULL AND up_{c}" for n, c in _FIT.items())}),
    c AS (SELECT indicator, count(*) AS n_cross, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(r) AS mean_return FROM u GROUP BY indicator)
    SELECT indicator, n, n_cross, {s_round("mean_distance")} AS mean_distance, {s_round("hit_rate")} AS hit_rate, {s_round("mean_return")} AS mean_return,
           CAST(row_number() OVER (ORDER BY round(hit_rate, 9) DESC, round(mean_distance, 9), indicator) AS INT) AS rank FROM f LEFT JOIN c USING (indicator)""",
)
def _(spark, sf):
    specs = [Indicator(f"ema_{n}", "ema", n, "low") for n in (20, 50, 82)] + [Indicator("dema_50", "dema", 50, "low")]
    return _out(ops.compare_indicators(_bars(spark, sf), specs), "mean_distance", "hit_rate", "mean_return", keys=("indicator", "n", "n_cross", "rank"))
