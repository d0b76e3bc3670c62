"""Queries over regimes, reliability, calibration, lifts, listings and set-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, intraday, outcomes, studies as ops
from ..operators.cross_section import daily_ic
from ..sources import tables
from .cross_section import _IC, FEATURES, PANEL, _panel
from .features import _bars, _out
from .registry import BARS, query, s_full, s_lag, s_lead, s_round
from .research import _TR, _trades

_CAL = """months AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 MONTH)) AS DATE) AS m),
    third AS (SELECT m, CAST(m + CAST((12 - isodow(m)) % 7 AS INT) AS DATE) + 14 AS d FROM months),
    cal AS (SELECT d AS date, 'expiry' AS event_type FROM third UNION ALL SELECT d, 'witching' FROM third WHERE month(m) % 3 = 0 UNION ALL SELECT last_day(m), 'quarter_end' FROM months WHERE month(m) % 3 = 0 UNION ALL SELECT last_day(m), 'half_year_end' FROM months WHERE month(m) % 6 = 0)"""


@query(
    "calendar_context",
    f"""WITH {BARS}, {_CAL}, x AS (SELECT DISTINCT ts FROM bars), n AS (SELECT ts, date_diff('day', ts, date) AS n, date_trunc('week', date) = date_trunc('week', ts) AS w FROM x JOIN cal ON event_type = 'expiry' AND abs(date_diff('day', ts, date)) <= 31),
    g AS (SELECT ts, CAST(first(n ORDER BY abs(n), n DESC) AS INT) AS days_to_event, bool_or(w) AS event_week FROM n GROUP BY ts) SELECT symbol, ts, days_to_event, coalesce(event_week, false) AS event_week FROM bars LEFT JOIN g USING (ts)""",
)
def _(spark, sf):
    return ops.calendar_context(_bars(spark, sf), ops.calendar_dim(spark, 1995, 2001)).select("symbol", "ts", "days_to_event", "event_week")


@query(
    "calendar_counts",
    f"WITH {BARS}, {_CAL} SELECT event_type, CAST(year(date) AS INT) AS year, count(DISTINCT date) AS n_dates, count(*) AS n_bars FROM cal JOIN bars ON ts = date GROUP BY event_type, year(date)",
)
def _(spark, sf):
    met = _bars(spark, sf).join(ops.calendar_dim(spark, 1995, 2001), F.col("ts") == F.col("date"))
    return met.groupBy("event_type", F.year("date").alias("year")).agg(F.countDistinct("date").alias("n_dates"), F.count(F.lit(1)).alias("n_bars"))


def _regimes(spark, sf):
    bars = tables.weekly_bars(spark, sf)
    market = features.market_bar(bars).withColumn("_a", features.sma(20))
    return market.where("_a is not null").select("ts", F.when(F.col("close") > F.col("_a"), "bull").otherwise("bear").alias("regime"))


_REG = f"market AS (SELECT 'market' AS symbol, ts, avg(close) AS close FROM weekly GROUP BY ts), ma AS (SELECT ts, close, {s_full(20, 'avg(close)')} AS a FROM market), reg AS (SELECT ts, CASE WHEN close > a THEN 'bull' ELSE 'bear' END AS regime FROM ma WHERE a IS NOT NULL)"


@query(
    "regime_ic",
    f"""WITH {_IC}, {_REG}, g AS (SELECT feature, regime, avg(ic) AS m, avg(CASE WHEN ic > 1e-12 THEN 1 ELSE 0 END) AS p, count(*) AS n FROM ics JOIN reg USING (ts) GROUP BY feature, regime)
    SELECT feature, regime, n AS n_dates, {s_round("m")} AS mean_ic, {s_round("p")} AS positive, CASE WHEN n >= 20 AND abs(m) >= 0.03 THEN CASE WHEN m > 0 THEN 'useful' ELSE 'inverse' END ELSE 'noise' END AS kind FROM g""",
)
def _(spark, sf):
    return _out(ops.regime_ic(_panel(spark, sf), FEATURES, "target", _regimes(spark, sf)), "mean_ic", "positive", keys=("feature", "regime", "n_dates", "kind"))


@query(
    "feature_reliability",
    f"""WITH {_IC.replace("k AS (", "kk AS (").replace("FROM k GROUP", "FROM kk GROUP")}, k AS (SELECT *, dense_rank() OVER (PARTITION BY feature ORDER BY ts DESC) AS k FROM ics), g AS (SELECT feature, {", ".join(f"avg(CASE WHEN k <= {w} THEN ic END) AS ic_{w}" for w in (30, 90, 180))} FROM k GROUP BY feature)
    SELECT feature, {", ".join(f"{s_round(f'ic_{w}')} AS ic_{w}" for w in (30, 90, 180))}, CASE WHEN ic_30 - ic_90 > 0.01 THEN 'improving' WHEN ic_30 - ic_90 < -0.01 THEN 'declining' ELSE 'stable' END AS trend FROM g""",
)
def _(spark, sf):
    return _out(ops.feature_reliability(daily_ic(_panel(spark, sf), FEATURES, "target")), "ic_30", "ic_90", "ic_180", keys=("feature", "trend"))


@query("feature_health")
def _(spark, sf):
    return _out(ops.feature_health(_panel(spark, sf), FEATURES, "target"), "mean_ic", "t_stat", "peer_corr", keys=("feature", "n_dates", "peer", "health"))


@query(
    "decile_spread",
    f"""WITH {PANEL}, d AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY roc_10 DESC, symbol) AS t, row_number() OVER (PARTITION BY ts ORDER BY roc_10, symbol) AS l, greatest(floor(count(*) OVER (PARTITION BY ts) * 0.1), 1) AS n FROM panel WHERE roc_10 IS NOT NULL AND target IS NOT NULL),
    g AS (SELECT ts, avg(CASE WHEN t <= n THEN target END) AS top, avg(CASE WHEN l <= n THEN target END) AS bottom FROM d GROUP BY ts) SELECT ts, {s_round("top")} AS top, {s_round("bottom")} AS bottom, {s_round("top - bottom")} AS spread FROM g""",
)
def _(spark, sf):
    return _out(ops.decile_spread(_panel(spark, sf), "roc_10", "target"), "top", "bottom", "spread", keys=("ts",))


@query(
    "topk_overlap",
    f"""WITH {PANEL}, d AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY roc_10 DESC, symbol) <= 5 AS a, row_number() OVER (PARTITION BY ts ORDER BY return_5d DESC, symbol) <= 5 AS b FROM panel WHERE roc_10 IS NOT NULL AND return_5d IS NOT NULL)
    SELECT ts, {s_round("count(*) FILTER (a AND b) / count(*) FILTER (a OR b)")} AS overlap FROM d GROUP BY ts""",
)
def _(spark, sf):
    return _out(ops.topk_overlap(_panel(spark, sf), "roc_10", "return_5d", 5), "overlap", keys=("ts",))


_KEYS = {"side": "CASE WHEN roc_10 > 0 THEN 'up' WHEN roc_10 <= 0 THEN 'down' END", "volume": "CASE WHEN volume >= 100 THEN 'high' ELSE 'low' END", "month": "CAST(month(ts) AS VARCHAR)"}


@query(
    "calibration_table",
    f"""WITH {PANEL}, l AS ({" UNION ALL ".join(f"SELECT '{n}' AS bucket_type, {c} AS bucket, target AS r FROM panel WHERE target IS NOT NULL" for n, c in _KEYS.items())}), g AS (SELECT bucket_type, bucket, count(*) AS n, avg(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS h, avg(r) AS m FROM l WHERE bucket IS NOT NULL GROUP BY 1, 2)
    SELECT bucket_type, bucket, n, {s_round("h")} AS hit_rate, {s_round("m")} AS mean, CASE WHEN n < 30 THEN 'insufficient' WHEN h >= 0.55 THEN 'positive' WHEN h <= 0.45 THEN 'negative' ELSE 'neutral' END AS status FROM g""",
)
def _(spark, sf):
    keys = {"side": F.when(F.col("roc_10") > 0, "up").when(F.col("roc_10") <= 0, "down"), "volume": F.when(F.col("volume") >= 100, "high").otherwise("low"), "month": F.month("ts")}
    return _out(ops.calibration_table(_panel(spark, sf), keys, "target"), "hit_rate", "mean", keys=("bucket_type", "bucket", "n", "status"))


_LABELS = f"""{BARS}, r0 AS (SELECT *, close / open - 1 AS br, high - low AS rg, volume > 100 AS heavy, close > open AS green FROM bars), c0 AS (SELECT symbol, quantile_cont(br, 0.1) AS lo, quantile_cont(br, 0.9) AS hi FROM r0 GROUP BY symbol),
    lb AS (SELECT r0.*, CASE WHEN br >= hi THEN 'rise' WHEN br <= lo THEN 'drop' ELSE 'none' END AS label FROM r0 JOIN c0 USING (symbol))"""


def _labels(spark, sf):
    rows = outcomes.percentile_labels(_bars(spark, sf))
    return rows.withColumns({"rg": F.col("high") - F.col("low"), "heavy": F.col("volume") > 100, "green": F.col("close") > F.col("open")})


@query(
    "event_lift",
    f"""WITH {_LABELS}, s AS (SELECT label, {s_lag("heavy::INT")} AS heavy, {s_lag("green::INT")} AS green FROM lb), l AS (SELECT 'heavy' AS flag, heavy AS o, label FROM s WHERE heavy IS NOT NULL UNION ALL SELECT 'green', green, label FROM s WHERE green IS NOT NULL),
    g AS (SELECT flag, count(*) AS n, avg(o) AS base, count(*) FILTER (label = 'rise' AND o = 1)::DOUBLE AS a, count(*) FILTER (label = 'rise' AND o = 0)::DOUBLE AS b, count(*) FILTER (label = 'drop' AND o = 1)::DOUBLE AS c, count(*) FILTER (label = 'drop' AND o = 0)::DOUBLE AS d FROM l GROUP BY flag)
    SELECT flag, n, {s_round("base")} AS base, {s_round("a / (a + b)")} AS rise_rate, {s_round("c / (c + d)")} AS drop_rate, {s_round("a / (a + b) / base")} AS rise_lift, {s_round("(a + b + c + d) * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * (a + c) * (b + d))")} AS chi2 FROM g""",
)
def _(spark, sf):
    return _out(ops.event_lift(_labels(spark, sf), ["heavy", "green"]), "base", "rise_rate", "drop_rate", "rise_lift", "chi2", keys=("flag", "n"))


@query(
    "event_shift",
    f"""WITH {_LABELS}, l AS (SELECT 'rg' AS feature, rg AS x, label FROM lb WHERE label <> 'none' UNION ALL SELECT 'volume', volume, label FROM lb WHERE label <> 'none'), k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS k FROM l),
    g AS (SELECT feature, count(*) FILTER (label = 'rise') AS n1, count(*) FILTER (label = 'drop') AS n2, sum(k) FILTER (label = 'rise') - count(*) FILTER (label = 'rise') * (count(*) FILTER (label = 'rise') + 1) / 2.0 AS u FROM k GROUP BY feature)
    SELECT feature, n1 AS n_rise, n2 AS n_drop, {s_round("u")} AS u, {s_round("2 * u / (n1 * n2) - 1")} AS cliffs_delta, {s_round("(2 * u / (n1 * n2)) / (2 - 2 * u / (n1 * n2))")} AS me FROM g""",
)
def _(spark, sf):
    return _out(ops.event_shift(_labels(spark, sf), ["rg", "volume"]), "u", "cliffs_delta", "me", keys=("feature", "n_rise", "n_drop"))


@query(
    "combo_walkforward",
    f"""WITH {_TR}, x AS (SELECT ts, symbol || '|' || CAST(direction AS VARCHAR) AS combo, ret_5 AS ret FROM tr), mo AS (SELECT DISTINCT CAST(date_trunc('month', ts) AS DATE) AS m FROM x),
    sc AS (SELECT m, combo FROM x JOIN mo ON ts >= m - 60 AND ts < m GROUP BY m, combo HAVING count(*) >= 5 AND avg(ret) > 0), nw AS (SELECT mo.m, ret, sc.combo IS NOT NULL AS picked FROM x JOIN mo ON CAST(date_trunc('month', ts) AS DATE) = mo.m LEFT JOIN sc ON sc.m = mo.m AND sc.combo = x.combo)
    SELECT m AS month, count(*) AS n_all, {s_round("avg(ret)")} AS mean_all, count(*) FILTER (picked) AS n_picked, {s_round("avg(ret) FILTER (picked)")} AS mean_picked FROM nw GROUP BY m""",
)
def _(spark, sf):
    rows = _trades(spark, sf).select("ts", F.concat_ws("|", "symbol", F.col("direction").cast("string")).alias("combo"), F.col("ret_5").alias("ret"))
    return _out(ops.combo_walkforward(rows, "combo"), "mean_all", "mean_picked", keys=("month", "n_all", "n_picked"))


_LIST = f"{BARS}, li AS (SELECT symbol, CAST(min(ts) + 400 AS DATE) AS listed FROM bars GROUP BY symbol), ix AS (SELECT b.*, listed, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS idx FROM bars b JOIN li USING (symbol) WHERE ts >= listed)"


def _listings(bars):
    return bars.groupBy("symbol").agg(F.date_add(F.min("ts"), 400).alias("listed"))


@query(
    "listing_event",
    f"""WITH {_LIST}, fo AS (SELECT *, max(CASE WHEN idx = 1 THEN open END) OVER (PARTITION BY symbol) AS fo FROM ix), y AS (SELECT * FROM fo WHERE idx <= 252)
    SELECT symbol, listed, {s_round("max(CASE WHEN idx = 1 THEN (close / open - 1) * 100 END)")} AS day1_pct, {", ".join(f"{s_round(f'(max(CASE WHEN idx <= {w} THEN high END) / min(CASE WHEN idx <= {w} THEN low END) - 1) * 100')} AS range_{w}" for w in (5, 21))},
           {s_round("(max(high) / max(fo) - 1) * 100")} AS peak_pct, CAST(first(idx ORDER BY high DESC, idx) AS INT) AS peak_bar, CAST(min(CASE WHEN close <= fo THEN idx END) AS INT) AS bars_to_open FROM y GROUP BY symbol, listed""",
)
def _(spark, sf):
    bars = _bars(spark, sf)
    return _out(ops.listing_event(_listings(bars), bars), "day1_pct", "range_5", "range_21", "peak_pct", keys=("symbol", "listed", "peak_bar", "bars_to_open"))


@query(
    "entry_offset_returns",
    f"""WITH {_LIST}, f AS (SELECT *, ({s_lead("close", 30)} / close - 1) * 100 AS r FROM ix) SELECT CAST(idx - 1 AS INT) AS "offset", count(*) AS n, {s_round("avg(r)")} AS mean, {s_round("quantile_cont(r, 0.5)")} AS median, {s_round("100.0 * avg(CASE WHEN r > 0 THEN 1 ELSE 0 END)")} AS win_pct
    FROM f WHERE idx - 1 IN (0, 5, 10, 20) AND r IS NOT NULL GROUP BY idx""",
)
def _(spark, sf):
    bars = _bars(spark, sf)
    return _out(ops.entry_offset_returns(_listings(bars), bars), "mean", "median", "win_pct", keys=("offset", "n"))


@query("intraday_setups")
def _(spark, sf):
    hours = tables.hourly_bars(spark, sf)
    return ops.setups(intraday.session_vwap(intraday.opening_range(hours)))


@query(
    "ablation",
    f"""WITH {PANEL}, s AS (SELECT target, sign(roc_10) AS a, sign(return_5d) AS b, sign(volume - 100) AS c FROM panel WHERE target IS NOT NULL AND roc_10 IS NOT NULL AND return_5d IS NOT NULL),
    l AS (SELECT 'none' AS without, target AS y, sign(0.5 * a + 0.3 * b + 0.2 * c) AS v FROM s UNION ALL SELECT 'a', target, sign(0.3 * b + 0.2 * c) FROM s UNION ALL SELECT 'b', target, sign(0.5 * a + 0.2 * c) FROM s UNION ALL SELECT 'c', target, sign(0.5 * a + 0.3 * b) FROM s)
    SELECT without, count(*) AS n, {s_round("avg(CASE WHEN y * v > 0 THEN 1 ELSE 0 END)")} AS hit_rate, {s_round("avg(y * v)")} AS expectancy FROM l WHERE v <> 0 AND abs(v) > 0 GROUP BY without""",
)
def _(spark, sf):
    rows = _panel(spark, sf).where("roc_10 is not null and return_5d is not null").select("target", F.signum("roc_10").alias("a"), F.signum("return_5d").alias("b"), F.signum(F.col("volume") - 100).alias("c"))
    return _out(ops.ablation(rows, {"a": 0.5, "b": 0.3, "c": 0.2}, "target"), "hit_rate", "expectancy", keys=("without", "n"))
