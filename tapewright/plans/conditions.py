"""Queries over conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import rounded
from ..operators import conditions as ops
from .features import _bars
from .registry import BARS, W, query, s_frame, s_full, s_lag, s_round

_B = f"WITH {BARS}, b AS (SELECT *, {s_lag('close')} AS p, {s_lag('high')} AS ph, {s_lag('low')} AS pl FROM bars)"


def _spec(name: str, specs: dict, sql: dict[str, str], source: str = _B, table: str = "b"):
    columns = ", ".join(f"coalesce({sql[c]}, false) AS {c}" for c in specs)

    @query(name, f"{source} SELECT symbol, ts, {columns} FROM {table}")
    def _(spark, sf):
        return ops.masks(_bars(spark, sf), specs).select("symbol", "ts", *specs)


_spec(
    "conditions_streak_gap",
    {"down_3": ("consecutive_down", {"n_days": 3}), "up_4": ("consecutive_up", {"n": 4}), "gap_down_5": ("gap_down", {"threshold_pct": 5}), "gap_up_5": ("gap_up", {"min_gap_pct": 5})},
    {
        "down_3": f"sum(CASE WHEN close < p THEN 1 ELSE 0 END) OVER {s_frame(3)} = 3",
        "up_4": f"sum(CASE WHEN close > p THEN 1 ELSE 0 END) OVER {s_frame(4)} = 4",
        "gap_down_5": "(open / p - 1) * 100 <= -5",
        "gap_up_5": "(open / p - 1) * 100 >= 5",
    },
)
_spec(
    "conditions_52w",
    {"near_low": ("near_52w_low", {"pct": 10}), "near_high": ("near_52w_high", {"pct": 10}), "breakout": ("breakout_52w_high", {}), "level": ("above_level", {"level": 1000.0})},
    {
        "near_low": f"close <= min(low) OVER {s_frame(252)} * (1 + 10 / 100.0)",
        "near_high": f"close >= max(high) OVER {s_frame(252)} * (1 - 10 / 100.0)",
        "breakout": f"close > {s_full(252, 'max(high)', -1)}",
        "level": "close > 1000",
    },
)
_spec(
    "conditions_average_volume",
    {
        "below_200": ("below_sma", {}), "above_50": ("above_sma", {}), "volume_2x": ("high_volume", {"multiplier": 1.5}),
        "climax_down": ("volume_climax_down", {"mult": 1.5}), "climax_up": ("volume_climax_up", {"mult": 1.5}),
    },
    {
        "below_200": f"close < {s_full(200, 'avg(close)')}",
        "above_50": f"close > {s_full(50, 'avg(close)')}",
        "volume_2x": f"volume >= 1.5 * {s_full(20, 'avg(volume)')}",
        "climax_down": f"volume >= 1.5 * {s_full(20, 'avg(volume)')} AND close < open",
        "climax_up": f"volume >= 1.5 * {s_full(20, 'avg(volume)')} AND close > open",
    },
)
_spec(
    "conditions_range",
    {"nr7": ("nr7", {}), "inside": ("inside_day", {}), "outside": ("outside_day", {})},
    {"nr7": f"high - low < {s_full(6, 'min(high - low)', -1)}", "inside": "high < ph AND low > pl", "outside": "high > ph AND low < pl"},
)
_spec(
    "conditions_calendar",
    {"month_end": ("end_of_month", {"n": 2}), "month_start": ("turn_of_month", {"n": 3}), "monday": ("day_of_week", {"day": 0}), "friday": ("day_of_week", {"day": 4})},
    {
        "month_end": "row_number() OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts DESC) <= 2",
        "month_start": "row_number() OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts) <= 3",
        "monday": "isodow(ts) = 1",
        "friday": "isodow(ts) = 5",
    },
)
_spec(
    "conditions_returns",
    {"rise": ("return_above_threshold", {}), "fall": ("return_below_threshold", {}), "expansion": ("volatility_expansion", {})},
    {
        "rise": "r5 > 0.1",
        "fall": "r5 < -0.1",
        "expansion": f"CASE WHEN count(r1) OVER {s_frame(5)} = 5 THEN stddev_samp(r1) OVER {s_frame(5)} END > 1.5 * CASE WHEN count(r1) OVER {s_frame(20)} = 20 THEN stddev_samp(r1) OVER {s_frame(20)} END",
    },
    f"WITH {BARS}, b AS (SELECT *, ln(close / {s_lag('close')}) AS r1, ln(close / {s_lag('close', 5)}) AS r5 FROM bars)",
)

@query(
    "find_signals",
    f"{_B}, m AS (SELECT *, sum(CASE WHEN close < p THEN 1 ELSE 0 END) OVER {s_frame(2)} = 2 AS down_2, close > {s_full(50, 'avg(close)')} AS above FROM b)"
    f" SELECT symbol, ts, {s_round('close')} AS close FROM m WHERE down_2 AND above",
)
def _(spark, sf):
    out = ops.find_signals(_bars(spark, sf), {"down": ("consecutive_down", {"n": 2}), "above": ("above_sma", {"n": 50})})
    return out.select("symbol", "ts", rounded(F.col("close")).alias("close"))


@query(
    "streaks",
    f"""WITH {BARS}, s AS (SELECT symbol, ts, CAST(coalesce(sign(close - {s_lag("close")}), 0) AS INT) AS s FROM bars),
    t AS (SELECT *, CASE WHEN s = {s_lag("s")} THEN 0 ELSE 1 END AS turn FROM s), r AS (SELECT *, sum(turn) OVER ({W}) AS run FROM t)
    SELECT symbol, ts, CAST(s * row_number() OVER (PARTITION BY symbol, run ORDER BY ts) AS INT) AS streak FROM r""",
)
def _(spark, sf):
    return ops.streaks(_bars(spark, sf)).select("symbol", "ts", "streak")


#: Third Fridays of four months: a small calendar of listed dates.
_DAYS = ("1996-03-15", "1997-06-20", "1998-09-18", "1999-12-17")
_DAYS_SQL = ", ".join(f"(DATE '{d}')" for d in _DAYS)


def _days(spark):
    return spark.createDataFrame([(d,) for d in _DAYS], "d string").select(F.to_date("d").alias("date"))


@query("near_calendar_day", f"WITH {BARS} SELECT symbol, ts FROM bars WHERE EXISTS (SELECT 1 FROM (VALUES {_DAYS_SQL}) v(d) WHERE abs(date_diff('day', d, ts)) <= 3)")
def _(spark, sf):
    return ops.near_calendar_day(_bars(spark, sf), _days(spark), 3).select("symbol", "ts")


@query("same_week", f"WITH {BARS} SELECT symbol, ts FROM bars WHERE date_trunc('week', ts) IN (SELECT date_trunc('week', d) FROM (VALUES {_DAYS_SQL}) v(d))")
def _(spark, sf):
    return ops.same_week(_bars(spark, sf), _days(spark)).select("symbol", "ts")


@query(
    "outperformance",
    f"""WITH {BARS}, j AS (SELECT x.ts, x.close AS a, y.close AS b FROM bars x JOIN bars y USING (ts) WHERE x.symbol = '1-URGENT' AND y.symbol = '5-LOW'),
    r AS (SELECT ts, (a / lag(a, 10) OVER (ORDER BY ts) - b / lag(b, 10) OVER (ORDER BY ts)) * 100 AS lead FROM j) SELECT ts, {s_round("lead")} AS lead FROM r WHERE lead >= 5""",
)
def _(spark, sf):
    out = ops.outperformance(_bars(spark, sf), "1-URGENT", "5-LOW", 5.0, 10)
    return out.select("ts", rounded(F.col("lead")).alias("lead"))
