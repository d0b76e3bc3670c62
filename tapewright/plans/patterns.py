"""Queries over candlestick patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import rounded
from ..operators import patterns as ops
from .features import _bars
from .registry import BARS, query, s_full, s_lag, s_lead, s_round

_LAGS = ", ".join(f"{s_lag(c, n)} AS {c}{n}" for n in (1, 2) for c in ("b", "g", "k", "a", "open", "close", "high", "low"))
_HAMMER = "r > 0 AND b / r < 0.35 AND d / r > 0.60 AND u / r < 0.10"
_INVERTED = "r > 0 AND b / r < 0.35 AND u / r > 0.60 AND d / r < 0.10"
_STAR = "b2 > 0.6 * a2 AND b1 < 0.3 * a1 AND b > 0.6 * a"
_THREE = "b2 > 0.5 * a2 AND b1 > 0.5 * a1 AND b > 0.5 * a"
_RULES = {
    "doji": "r > 0 AND b / r < 0.1",
    "hammer": _HAMMER,
    "inverted_hammer": _INVERTED,
    "shooting_star": f"{_INVERTED} AND k",
    "hanging_man": f"{_HAMMER} AND k",
    "marubozu_bull": "g AND r > 0 AND d / r < 0.02 AND u / r < 0.02",
    "marubozu_bear": "k AND r > 0 AND d / r < 0.02 AND u / r < 0.02",
    "spinning_top": "r > 0 AND b / r < 0.30 AND d / r > 0.25 AND u / r > 0.25",
    "long_bull": "g AND b > 1.5 * a",
    "long_bear": "k AND b > 1.5 * a",
    "engulfing_bull": "k1 AND g AND open <= close1 AND close >= open1",
    "engulfing_bear": "g1 AND k AND open >= close1 AND close <= open1",
    "harami_bull": "k1 AND g AND open > close1 AND close < open1",
    "harami_bear": "g1 AND k AND open < close1 AND close > open1",
    "piercing_line": "k1 AND g AND open < close1 AND close > (open1 + close1) / 2 AND close < open1",
    "dark_cloud_cover": "g1 AND k AND open > close1 AND close < (open1 + close1) / 2 AND close > open1",
    "tweezer_bottom": "low <> 0 AND abs(low - low1) / low < 0.001",
    "tweezer_top": "high <> 0 AND abs(high - high1) / high < 0.001",
    "morning_star": f"k2 AND {_STAR} AND g AND close > (open2 + close2) / 2",
    "evening_star": f"g2 AND {_STAR} AND k AND close < (open2 + close2) / 2",
    "three_white_soldiers": f"g2 AND g1 AND g AND {_THREE} AND open1 > open2 AND close1 > close2 AND open > open1 AND close > close1",
    "three_black_crows": f"k2 AND k1 AND k AND {_THREE} AND open1 < open2 AND close1 < close2 AND open < open1 AND close < close1",
    "three_inside_up": "k2 AND g1 AND open1 > close2 AND close1 < open2 AND g AND close > close1",
    "three_inside_down": "g2 AND k1 AND open1 < close2 AND close1 > open2 AND k AND close < close1",
}
PATTERNS = f"""{BARS},
    x AS (SELECT *, abs(close - open) AS b, high - low AS r, high - greatest(open, close) AS u, least(open, close) - low AS d, close > open AS g, close < open AS k FROM bars),
    x2 AS (SELECT *, {s_full(14, "avg(r)")} AS a, {s_full(20, "avg(volume)", -1)} AS v20 FROM x),
    y AS (SELECT *, {_LAGS} FROM x2),
    pat AS (SELECT symbol, ts, open, high, low, close, volume, v20, {", ".join(f"coalesce({rule}, false) AS {n}" for n, rule in _RULES.items())} FROM y),
    sig AS ({" UNION ALL ".join(f"SELECT symbol, ts, '{n}' AS pattern, '{ops.BIAS[n]}' AS bias, open, high, low, close, volume, v20 FROM pat WHERE {n}" for n in _RULES)})"""


@query("candlestick_patterns", f"WITH {PATTERNS} SELECT symbol, ts, {', '.join(_RULES)} FROM pat")
def _(spark, sf):
    return ops.candlestick_patterns(_bars(spark, sf)).select("symbol", "ts", *ops.BIAS)


@query(
    "pattern_signals",
    f"WITH {PATTERNS} SELECT symbol, ts, pattern, bias, {s_round('0.6 * CASE WHEN high - low > 0 THEN abs(close - open) / (high - low) ELSE 0 END + 0.4 * least(coalesce(volume / v20, 1), 3) / 3')} AS strength FROM sig",
)
def _(spark, sf):
    return ops.pattern_signals(_bars(spark, sf)).withColumn("strength", rounded(F.col("strength")))


@query(
    "pattern_context",
    f"""WITH {BARS}, x AS (SELECT symbol, ts, close, close / {s_lag("close", 20)} - 1 AS r, {s_full(20, "avg(close)", -1)} AS m, volume / ({s_full(20, "avg(volume)", -1)}) AS v FROM bars)
    SELECT symbol, ts, CASE WHEN r > 0.05 THEN 'up' WHEN r < -0.05 THEN 'down' WHEN r IS NOT NULL THEN 'flat' END AS regime, close > m AS above_mean,
           CASE WHEN v >= 1.5 THEN 'high' WHEN v <= 0.5 THEN 'low' WHEN v IS NOT NULL THEN 'normal' END AS volume_context FROM x""",
)
def _(spark, sf):
    return ops.pattern_context(_bars(spark, sf)).select("symbol", "ts", "regime", "above_mean", "volume_context")


@query(
    "pattern_outcome_stats",
    f"""WITH {PATTERNS}, f AS (SELECT symbol, ts, ({s_lead("close", 5)} / close - 1) * 100 AS f FROM bars), j AS (SELECT sig.pattern, sig.bias, ts, f FROM sig JOIN f USING (symbol, ts) WHERE f IS NOT NULL)
    SELECT pattern, bias, count(*) AS n, {s_round("avg(f)", 4)} AS mean, {s_round("CASE WHEN count(*) > 1 THEN stddev_samp(f) END", 4)} AS std, {s_round("avg(CASE WHEN f > 0 THEN 1 ELSE 0 END)", 4)} AS hit_rate,
           min(ts) AS first_ts, max(ts) AS last_ts FROM j GROUP BY pattern, bias""",
)
def _(spark, sf):
    out = ops.pattern_outcome_stats(_bars(spark, sf))
    return out.select("pattern", "bias", "n", *[rounded(F.col(c), 4).alias(c) for c in ("mean", "std", "hit_rate")], "first_ts", "last_ts")


_TA_LAGS = ", ".join(f"{s_lag(c, n)} AS {c}{n}" for n in (1, 2) for c in ("b", "g", "k", "up", "down", "open", "close", "high", "low"))
_BELOW, _ABOVE = "d >= 2 * b AND place <= 0.25 AND u <= 0.25 * b", "u >= 2 * b AND place >= 0.75 AND d <= 0.25 * b"
_BODIES = "b2 > 0.5 * mean AND b1 > 0.5 * mean AND b > 0.5 * mean"
_TA = {
    "doji": "bp < 0.05 AND u >= 2 * b AND d >= 2 * b", "long_legged_doji": "bp < 0.05 AND u >= 3 * b AND d >= 3 * b AND r >= 1.5 * av",
    "hammer": f"{_BELOW} AND down", "inverted_hammer": f"{_ABOVE} AND down", "shooting_star": f"{_ABOVE} AND up", "hanging_man": f"{_BELOW} AND up", "marubozu": "us < 0.05 AND ls < 0.05",
    "spinning_top": "bp < 0.25 AND u >= b AND d >= b AND abs(u - d) <= 0.3 * greatest(u, d)",
    "bullish_engulfing": "down1 AND g AND open < close1 AND close > open1 AND close - open > open1 - close1", "bearish_engulfing": "up1 AND k AND open > close1 AND close < open1 AND open - close > close1 - open1",
    "inside_bar": "high < high1 AND low > low1", "outside_bar": "high > high1 AND low < low1",
    "harami": "b < b1 AND CASE WHEN g1 THEN open > open1 AND close < close1 AND open < close1 AND close > open1 ELSE open < open1 AND close > close1 AND open > close1 AND close < open1 END",
    "tweezer_top": "up1 AND k AND abs(high1 - high) <= 0.01 * (high1 + high) / 2", "tweezer_bottom": "down1 AND g AND abs(low1 - low) <= 0.01 * (low1 + low) / 2",
    "morning_star": "down2 AND k2 AND b1 < 0.5 * mean AND low1 < low2 AND g AND close > (open2 + close2) / 2", "evening_star": "up2 AND g2 AND b1 < 0.5 * mean AND high1 > high2 AND k AND close < (open2 + close2) / 2",
    "three_white_soldiers": f"g2 AND g1 AND g AND close1 > close2 AND close > close1 AND open1 > open2 AND open1 < close2 AND open > open1 AND open < close1 AND {_BODIES}",
    "three_black_crows": f"k2 AND k1 AND k AND close1 < close2 AND close < close1 AND open1 < open2 AND open1 > close2 AND open < open1 AND open > close1 AND {_BODIES}",
}


@query(
    "trend_aware_patterns",
    f"""WITH {BARS}, x AS (SELECT *, abs(close - open) AS b, high - low AS r, high - greatest(open, close) AS u, least(open, close) - low AS d, close > open AS g, close < open AS k,
        coalesce(close > {s_lag("close")} AND {s_lag("close")} > {s_lag("close", 2)}, false) AS up, coalesce(close < {s_lag("close")} AND {s_lag("close")} < {s_lag("close", 2)}, false) AS down FROM bars),
    y AS (SELECT *, coalesce(b / nullif(r, 0), 0) AS bp, coalesce(u / nullif(r, 0), 0) AS us, coalesce(d / nullif(r, 0), 0) AS ls, coalesce((least(open, close) - low) / nullif(r, 0), 0) AS place,
        coalesce({s_full(20, "avg(r)")}, r) AS av, avg(b) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mean, {_TA_LAGS} FROM x)
    SELECT symbol, ts, {", ".join(f"coalesce({rule}, false) AS {n}" for n, rule in _TA.items())} FROM y""",
)
def _(spark, sf):
    return ops.trend_aware_patterns(_bars(spark, sf)).select("symbol", "ts", *ops.TREND_AWARE)
