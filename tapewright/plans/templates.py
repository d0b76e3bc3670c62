"""Queries over trade templates, outcome groups and extracted conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns, templates as ops, texts
from ..sources import tables
from .features import _bars, _out
from .outcomes import _PATH
from .patterns import PATTERNS
from .registry import BARS, W, query, s_frame, s_lag, s_lead, s_round
from .research import _TR, _trades
from .rest import _CLAIMS_SQL, _EXTRACT, _SENT, _claims


@query("signals_per_day", f"WITH {_TR} SELECT ts, count(*) AS n, count(*) FILTER (direction > 0) AS n_long, count(*) FILTER (direction < 0) AS n_short FROM tr GROUP BY ts")
def _(spark, sf):
    return ops.signals_per_day(_trades(spark, sf))


_FILTERS = {"all": ("true", lambda: F.lit(True)), "volume_120": ("volume >= 120", lambda: F.col("volume") >= 120), "turnover_100k": ("turnover >= 100000", lambda: F.col("turnover") >= 100000)}


@query(
    "liquidity_sweep",
    f"""WITH {_TR}, li AS (SELECT symbol, avg(volume) AS volume, avg(close * volume) AS turnover FROM bars GROUP BY symbol), j AS (SELECT ret_5, li.volume, turnover FROM tr JOIN li USING (symbol))
    {" UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) AS n, {s_round('avg(ret_5)')} AS expectancy, {s_round('avg(CASE WHEN ret_5 > 0 THEN 1 ELSE 0 END)')} AS win_rate FROM j WHERE {c} HAVING count(*) > 0" for n, (c, _f) in _FILTERS.items())}""",
)
def _(spark, sf):
    return _out(ops.liquidity_sweep(_trades(spark, sf), _bars(spark, sf), {n: f() for n, (_c, f) in _FILTERS.items()}), "expectancy", "win_rate", keys=("filter", "n"))


@query(
    "size_positions",
    f"""WITH {_TR}, z AS (SELECT ret_5, greatest(coalesce(atr_pct, avg(atr_pct) OVER ()), 0.5) AS a FROM tr), l AS (SELECT 'fixed_1000' AS rule, 1000.0 AS size, ret_5 FROM z UNION ALL SELECT 'fixed_10000', 10000.0, ret_5 FROM z UNION ALL SELECT 'fixed_risk', 100.0 / (1.5 * a / 100), ret_5 FROM z)
    SELECT rule, count(*) AS n, {s_round("sum(size * ret_5 / 100)", 2)} AS profit, {s_round("avg(size)", 2)} AS mean_size, {s_round("min(size * ret_5 / 100)", 2)} AS worst FROM l GROUP BY rule""",
)
def _(spark, sf):
    return _out(ops.size_positions(_trades(spark, sf)), "profit", "mean_size", "worst", keys=("rule", "n"), digits=2)


_G = [f"{k}_{h}" for h in (1, 5, 10) for k in ("hit", "mean", "median")]


@query(
    "group_outcomes",
    f"""WITH {BARS}, f AS (SELECT CAST(isodow(ts) - 1 AS INT) AS day, {", ".join(f"({s_lead('close', h)} / close - 1) * 100 AS f{h}" for h in (1, 5, 10))}, {_PATH} FROM bars)
    SELECT day, count(*) AS n, {s_round("avg(max_runup_20d)")} AS runup, {s_round("avg(max_drawdown_20d)")} AS drawdown, {", ".join(f"{s_round(f'avg(CASE WHEN f{h} > 0 THEN 1 WHEN f{h} <= 0 THEN 0 END)')} AS hit_{h}, {s_round(f'avg(f{h})')} AS mean_{h}, {s_round(f'quantile_cont(f{h}, 0.5)')} AS median_{h}" for h in (1, 5, 10))} FROM f GROUP BY day""",
)
def _(spark, sf):
    rows = ops.outcomes_of(_bars(spark, sf)).withColumn("day", F.weekday("ts"))
    return _out(ops.group_outcomes(rows, "day"), "runup", "drawdown", *_G, keys=("day", "n"))


@query(
    "pattern_event_outcomes",
    f"""WITH {PATTERNS}, f AS (SELECT symbol, ts, {", ".join(f"({s_lead('close', h)} / close - 1) * 100 AS ret_{h}" for h in ops.HORIZONS)}, (max(high) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) / close - 1) * 100 AS up, (min(low) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) / close - 1) * 100 AS dn FROM bars)
    SELECT sig.symbol, sig.ts, pattern, bias, {", ".join(f"{s_round(f'ret_{h}')} AS ret_{h}" for h in ops.HORIZONS)}, {s_round("CASE bias WHEN 'bullish' THEN up WHEN 'bearish' THEN -dn END")} AS mfe, {s_round("CASE bias WHEN 'bullish' THEN dn WHEN 'bearish' THEN -up END")} AS mae,
           CASE bias WHEN 'bullish' THEN up >= 1 WHEN 'bearish' THEN dn <= -1 END AS target_hit, CASE bias WHEN 'bullish' THEN dn <= -1 WHEN 'bearish' THEN up >= 1 END AS stop_hit FROM sig JOIN f ON sig.symbol = f.symbol AND sig.ts = f.ts""",
)
def _(spark, sf):
    bars = _bars(spark, sf)
    out = ops.pattern_event_outcomes(patterns.pattern_signals(bars).drop("strength"), bars)
    return _out(out, *[f"ret_{h}" for h in ops.HORIZONS], "mfe", "mae", keys=("symbol", "ts", "pattern", "bias", "target_hit", "stop_hit"))


@query("chunk_text")
def _(spark, sf):
    return ops.chunk_text(tables.read(spark, sf, "documents"))


_HYP = {("consecutive_down", float(n)): ("consecutive_down", {"n": n}) for n in range(2, 6)} | {("gap_up", 10.0): ("gap_up", {"min_gap_pct": 10.0})}


@query(
    "test_hypotheses",
    f"""WITH {_CLAIMS_SQL}, {_SENT.replace("FROM documents", "FROM claims")}, x AS ({_EXTRACT}), y AS (SELECT condition, value FROM x WHERE value BETWEEN CASE WHEN parameter = 'n' THEN 2 ELSE 0.1 END AND CASE WHEN parameter = 'n' THEN 10 ELSE 20 END QUALIFY row_number() OVER (PARTITION BY doc_id, condition, value ORDER BY place) = 1),
    st AS (SELECT condition, value, count(*) AS n_stated FROM y GROUP BY 1, 2), {BARS}, b AS (SELECT *, {s_lag("close")} AS p, ({s_lead("close", 5)} / close - 1) * 100 AS r FROM bars), m AS (SELECT r, (open / p - 1) * 100 >= 10 AS gap, {", ".join(f"sum(CASE WHEN close < p THEN 1 ELSE 0 END) OVER {s_frame(n)} = {n} AS d{n}" for n in range(2, 6))} FROM b),
    l AS ({" UNION ALL ".join(f"SELECT 'consecutive_down' AS condition, {n}.0::DOUBLE AS value, r FROM m WHERE d{n} AND r IS NOT NULL" for n in range(2, 6))} UNION ALL SELECT 'gap_up', 10.0::DOUBLE, r FROM m WHERE gap AND r IS NOT NULL)
    SELECT l.condition, {s_round("l.value")} AS value, any_value(n_stated) AS n_stated, count(*) AS n, {s_round("avg(CASE WHEN r > 0 THEN 1 ELSE 0 END)")} AS hit_rate, {s_round("avg(r)")} AS mean FROM l JOIN st ON st.condition = l.condition AND st.value = l.value GROUP BY l.condition, l.value""",
)
def _(spark, sf):
    out = ops.test_hypotheses(texts.extract_conditions(_claims(spark, sf)), _bars(spark, sf), _HYP)
    return _out(out, "value", "hit_rate", "mean", keys=("condition", "n_stated", "n"))
