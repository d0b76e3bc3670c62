"""Queries over table upkeep, validation and buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import rounded
from ..operators import tables as ops
from ..operators.features import log_return, roc
from ..sources import tables
from .features import _bars, _out
from .registry import BARS, HOURLY, query, s_full, s_lag, s_round

_OLD = "old AS (SELECT symbol, ts, close, volume FROM bars WHERE ts < DATE '1999-01-01')"
_NEW = "new AS (SELECT symbol, ts, CASE WHEN volume > 100 THEN close * 2 END AS close, CASE WHEN volume > 60 THEN volume + 1 END AS volume FROM bars WHERE ts >= DATE '1998-06-01')"


def _two(spark, sf):
    bars = _bars(spark, sf).select("symbol", "ts", "close", "volume")
    old = bars.where("ts < date'1999-01-01'")
    new = bars.where("ts >= date'1998-06-01'").select("symbol", "ts", F.expr("case when volume > 100 then close * 2 end close"), F.expr("case when volume > 60 then volume + 1 end volume"))
    return old, new


@query(
    "upsert",
    f"""WITH {BARS}, {_OLD}, {_NEW} SELECT coalesce(n.symbol, o.symbol) AS symbol, coalesce(n.ts, o.ts) AS ts, {s_round("coalesce(n.close, o.close)")} AS close,
    {s_round("CASE WHEN n.symbol IS NOT NULL THEN n.volume ELSE o.volume END")} AS volume FROM old o FULL JOIN new n ON o.symbol = n.symbol AND o.ts = n.ts""",
)
def _(spark, sf):
    return _out(ops.upsert(*_two(spark, sf), ["symbol", "ts"], ["close"]), "close", "volume")


@query("append_new", f"WITH {BARS}, {_OLD}, {_NEW} SELECT symbol, ts, {s_round('close')} AS close FROM (SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.symbol = n.symbol AND o.ts = n.ts))")
def _(spark, sf):
    return _out(ops.append_new(*_two(spark, sf), ["symbol", "ts"]), "close")


@query("latest_per_key", f"WITH {BARS} SELECT symbol, ts, {s_round('close')} AS close, {s_round('volume')} AS volume FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
def _(spark, sf):
    return _out(ops.latest_per_key(_bars(spark, sf).select("symbol", "ts", "close", "volume"), ["symbol"], ["ts"]), "close", "volume")


_WIDE = f"wide AS (SELECT symbol, ts, close / {s_lag('close', 10)} - 1 AS roc_10, ln(close / {s_lag('close', 5)}) AS return_5d, volume FROM bars)"
_NAMES = ["roc_10", "return_5d", "volume"]


def _wide(spark, sf):
    return _bars(spark, sf).select("symbol", "ts", roc(10).alias("roc_10"), log_return(5).alias("return_5d"), "volume")


_LONG = " UNION ALL ".join(f"SELECT symbol, ts, '{n}' AS feature_name, {n} AS feature_value FROM wide WHERE {n} IS NOT NULL" for n in _NAMES)


@query("unpivot_features", f"WITH {BARS}, {_WIDE}, l AS ({_LONG}) SELECT symbol, ts, feature_name, {s_round('feature_value')} AS feature_value FROM l")
def _(spark, sf):
    return _out(ops.unpivot_features(_wide(spark, sf), _NAMES), "feature_value", keys=("symbol", "ts", "feature_name"))


@query("pivot_features", f"WITH {BARS}, {_WIDE} SELECT symbol, ts, {', '.join(f'{s_round(n)} AS {n}' for n in _NAMES)}, CAST(NULL AS DOUBLE) AS absent FROM wide")
def _(spark, sf):
    out = ops.pivot_features(ops.unpivot_features(_wide(spark, sf), _NAMES), [*_NAMES, "absent"])
    return _out(out, *_NAMES, "absent")


@query(
    "infer_listings",
    f"""WITH {BARS}, c AS (SELECT p.symbol || '-' || CAST(year(ts) // 2 AS VARCHAR) AS symbol, ts, open, close FROM bars p), f AS (SELECT symbol, min(ts) AS listed, (arg_min(close, ts) / arg_min(open, ts) - 1) * 100 AS pop FROM c GROUP BY symbol)
    SELECT symbol, listed, {s_round("pop")} AS pop_pct, CASE WHEN pop >= 30 THEN 'hot' WHEN pop >= 10 THEN 'warm' WHEN pop >= 0 THEN 'cold' ELSE 'broken' END AS pop_class FROM f WHERE listed > DATE '1996-06-30'""",
)
def _(spark, sf):
    bars = _bars(spark, sf).withColumn("symbol", F.concat_ws("-", "symbol", F.floor(F.year("ts") / 2).cast("string")))
    return _out(ops.infer_listings(bars, "1996-06-30"), "pop_pct", keys=("symbol", "listed", "pop_class"))


@query(
    "bucketize",
    f"""WITH {BARS}, {_WIDE} SELECT symbol, ts, CASE WHEN roc_10 < -0.2 THEN 'crash' WHEN roc_10 < 0 THEN 'down' WHEN roc_10 < 0.2 THEN 'up' WHEN roc_10 >= 0.2 THEN 'surge' ELSE 'unk' END AS bucket FROM wide""",
)
def _(spark, sf):
    return _wide(spark, sf).select("symbol", "ts", ops.bucketize(F.col("roc_10"), [-0.2, 0.0, 0.2], ["crash", "down", "up", "surge"], "unk").alias("bucket"))


_KEY = "'day=' || CAST(isodow(ts) - 1 AS VARCHAR) || '|side=' || coalesce(CASE WHEN roc_10 > 0 THEN 'up' WHEN roc_10 <= 0 THEN 'down' END, 'unk')"


@query("combo_key", f"WITH {BARS}, {_WIDE} SELECT {_KEY} AS combo, count(*) AS n FROM wide GROUP BY 1")
def _(spark, sf):
    rows = _wide(spark, sf)
    side = F.when(F.col("roc_10") > 0, "up").when(F.col("roc_10") <= 0, "down")
    return rows.select(ops.combo_key({"day": F.weekday("ts"), "side": side}).alias("combo")).groupBy("combo").agg(F.count(F.lit(1)).alias("n"))


@query("parse_combo_key", f"WITH {BARS}, {_WIDE} SELECT CAST(isodow(ts) - 1 AS VARCHAR) AS day, CASE WHEN roc_10 > 0 THEN 'up' WHEN roc_10 <= 0 THEN 'down' END AS side, count(*) AS n FROM wide GROUP BY 1, 2")
def _(spark, sf):
    side = F.when(F.col("roc_10") > 0, "up").when(F.col("roc_10") <= 0, "down")
    keys = _wide(spark, sf).select(ops.combo_key({"day": F.weekday("ts"), "side": side}).alias("k"))
    parsed = ops.parse_combo_key(F.col("k"), ["day", "side"])
    return keys.groupBy(*[c.alias(n) for n, c in parsed.items()]).agg(F.count(F.lit(1)).alias("n"))


#: Bars with a defect for every symbol: many nulls, few nulls, a wrong ratio, a stuck feed, none.
_DEFECTS_SQL = """bad AS (SELECT * REPLACE (CASE
        WHEN symbol = '1-URGENT' AND day(ts) = 13 THEN NULL
        WHEN symbol = '2-HIGH' AND day(ts) = 13 AND month(ts) = 1 THEN NULL
        WHEN symbol = '3-MEDIUM' THEN adjusted_close * 4
        WHEN symbol = '5-LOW' AND ts >= DATE '1998-06-01' THEN 7.5
        ELSE adjusted_close END AS adjusted_close) FROM daily)"""


def _defects(spark, sf):
    price = F.col("adjusted_close")
    bad = F.when((F.col("symbol") == "1-URGENT") & (F.dayofmonth("ts") == 13), None)
    bad = bad.when((F.col("symbol") == "2-HIGH") & (F.dayofmonth("ts") == 13) & (F.month("ts") == 1), None)
    bad = bad.when(F.col("symbol") == "3-MEDIUM", price * 4).when((F.col("symbol") == "5-LOW") & (F.col("ts") >= F.lit("1998-06-01").cast("date")), 7.5)
    return tables.daily_bars(spark, sf).withColumn("adjusted_close", bad.otherwise(price))


_VALID = f"""{_DEFECTS_SQL},
    v AS (
        SELECT *, date_diff('day', {s_lag("ts")}, ts) AS gap,
               row_number() OVER (PARTITION BY symbol, adjusted_close IS NULL ORDER BY ts DESC) AS kp, row_number() OVER (PARTITION BY symbol, volume IS NULL ORDER BY ts DESC) AS kv
        FROM bad),
    a AS (
        SELECT symbol, count(*) AS n, count(*) FILTER (adjusted_close IS NULL) AS nulls, min(adjusted_close) AS lowest, count(DISTINCT ts) AS dates,
               count(DISTINCT adjusted_close) FILTER (adjusted_close IS NOT NULL AND kp <= 10) AS tens, max(gap) AS gap, max(ts) AS last,
               max(volume) FILTER (volume IS NOT NULL AND kv = 1) AS size, avg(volume) FILTER (volume IS NOT NULL AND kv BETWEEN 2 AND 21) AS mean_size, count(volume) AS sizes,
               max(adjusted_close / close) FILTER (close > 0) AS ratio
        FROM v GROUP BY symbol),
    w AS (
        SELECT *, nulls > 0 AS w1, coalesce(gap > 5, false) AS w2, coalesce(sizes >= 21 AND mean_size > 0 AND size > 20 * mean_size, false) AS w3, coalesce(ratio > 3, false) AS w4,
               coalesce(last > DATE '1998-11-01', false) AS w5,
               CASE WHEN n < 15 THEN 'insufficient_bars' WHEN 100.0 * nulls / n >= 2 THEN 'nan_prices_high' WHEN lowest <= 0 THEN 'nonpositive_price' WHEN dates < n THEN 'duplicate_dates'
                    WHEN n - nulls >= 10 AND tens = 1 THEN 'flat_prices' ELSE '' END AS fatal
        FROM a),
    f AS (
        SELECT symbol, n, fatal,
               CASE WHEN fatal = '' THEN concat_ws('|', CASE WHEN w1 THEN 'nan_prices_low' END, CASE WHEN w2 THEN 'date_gap' END, CASE WHEN w3 THEN 'volume_outlier' END,
                    CASE WHEN w4 THEN 'adjustment_anomaly' END, CASE WHEN w5 THEN 'future_date' END) ELSE '' END AS flags,
               CASE WHEN fatal = '' THEN 1 - (CASE WHEN w1 THEN 0.05 ELSE 0 END + CASE WHEN w2 THEN 0.1 ELSE 0 END + CASE WHEN w3 THEN 0.15 ELSE 0 END + CASE WHEN w4 THEN 0.2 ELSE 0 END
                    + CASE WHEN w5 THEN 0.05 ELSE 0 END) ELSE 0 END AS score
        FROM w)"""


@query("validate_bars", f"WITH {BARS}, {_VALID} SELECT symbol, n, fatal = '' AS ok, {s_round('score')} AS score, fatal, flags FROM f")
def _(spark, sf):
    return _out(ops.validate_bars(_defects(spark, sf), "1998-11-01"), "score", keys=("symbol", "n", "ok", "fatal", "flags"))


@query(
    "validation_summary",
    f"""WITH {BARS}, {_VALID} SELECT count(*) AS n, count(*) FILTER (fatal = '' AND flags = '') AS clean, count(*) FILTER (fatal = '' AND flags <> '') AS warned, count(*) FILTER (fatal <> '') AS fatal,
    {s_round("100.0 * count(*) FILTER (fatal <> '') / count(*)")} AS failure_pct FROM f""",
)
def _(spark, sf):
    return _out(ops.validation_summary(ops.validate_bars(_defects(spark, sf), "1998-11-01")), "failure_pct", keys=("n", "clean", "warned", "fatal"))


#: Bars brought to the prices and volumes of other markets, one for each tier.
_SCALED_SQL = """scaled AS (SELECT * REPLACE (close / CASE symbol WHEN '2-HIGH' THEN 40 WHEN '3-MEDIUM' THEN 120 WHEN '4-NOT SPECIFIED' THEN 400 ELSE 1 END AS close, volume * 20000 AS volume) FROM bars)"""


def _scaled(spark, sf):
    part = F.when(F.col("symbol") == "2-HIGH", 40).when(F.col("symbol") == "3-MEDIUM", 120).when(F.col("symbol") == "4-NOT SPECIFIED", 400).otherwise(1)
    return _bars(spark, sf).withColumns({"close": F.col("close") / part, "volume": F.col("volume") * 20000})


@query(
    "quality_tier",
    f"""WITH {BARS}, {_SCALED_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM scaled), a AS (SELECT symbol, quantile_cont(close, 0.5) AS m, avg(close * volume) AS t FROM l WHERE back <= 252 GROUP BY symbol)
    SELECT symbol, {s_round("m", 4)} AS median_close, round(t, 2) + 0.0 AS turnover,
           CASE WHEN m > 50 AND t > 25000000 THEN 1 WHEN m BETWEEN 20 AND 50 AND t > 5000000 THEN 2 WHEN m BETWEEN 5 AND 20 AND t > 1000000 THEN 3 ELSE 4 END AS tier FROM a""",
)
def _(spark, sf):
    out = ops.quality_tier(_scaled(spark, sf))
    return out.select("symbol", rounded(F.col("median_close"), 4).alias("median_close"), rounded(F.col("turnover"), 2).alias("turnover"), "tier")


@query(
    "profile_matrix",
    f"WITH {BARS}, {_WIDE} " + " UNION ALL ".join(f"SELECT ts, count(*) AS n_rows, '{n}' AS feature, {s_round(f'100.0 * count(*) FILTER ({n} IS NULL) / count(*)')} AS null_pct FROM wide GROUP BY ts" for n in _NAMES),
)
def _(spark, sf):
    return _out(ops.profile_matrix(_wide(spark, sf), _NAMES), "null_pct", keys=("ts", "n_rows", "feature"))


@query("resolve_universe", f"WITH {BARS} SELECT DISTINCT symbol FROM bars WHERE symbol = '5-LOW'")
def _(spark, sf):
    return ops.resolve_universe(_bars(spark, sf), "5-LOW")


@query(
    "asof_daily_context",
    f"""WITH {HOURLY}, d AS (SELECT symbol, session, max(high) AS day_high FROM hourly GROUP BY symbol, session)
    SELECT h.symbol, h.ts, {s_round("(SELECT arg_max(day_high, d.session) FROM d WHERE d.symbol = h.symbol AND d.session < h.session)")} AS day_high FROM hourly h""",
)
def _(spark, sf):
    hours = tables.hourly_bars(spark, sf).select("symbol", "ts", "session", "high")
    days = hours.groupBy("symbol", "session").agg(F.max("high").alias("day_high"))
    out = ops.asof_join(hours.drop("high"), days, "day_high", at="session")
    return _out(out, "day_high")
