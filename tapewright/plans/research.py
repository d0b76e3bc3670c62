"""Queries over suites, trades, slices and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import lag
from ..operators import conditions, cross_section, features, outcomes, research as ops
from .features import _bars, _out
from .outcomes import _FWD, _SHARPE, _STATS, LONG, _events, _tail
from .registry import BARS, query, s_frame, s_full, s_lag, s_lead, s_round

_SUITE = {"down_2": ("consecutive_down", {"n": 2}), "gap_up": ("gap_up", {"min_gap_pct": 10}), "above_50": ("above_sma", {"n": 50})}
_SUITE_SQL = f"""{BARS}, f AS (SELECT *, {s_lag("close")} AS p, {_FWD} FROM bars), m AS (SELECT *, sum(CASE WHEN close < p THEN 1 ELSE 0 END) OVER {s_frame(2)} = 2 AS down_2, (open / p - 1) * 100 >= 10 AS gap_up, close > {s_full(50, "avg(close)")} AS above_50 FROM f),
    l AS ({" UNION ALL ".join(f"SELECT symbol, '{c}' AS condition, {h} AS horizon, fwd_{h}d AS ret FROM m WHERE {c} AND fwd_{h}d IS NOT NULL" for c in _SUITE for h in (1, 5, 10))})"""


@query(
    "run_suite",
    f"WITH {_SUITE_SQL} SELECT condition, horizon, CASE WHEN grouping(symbol) = 1 THEN 'ALL' ELSE symbol END AS symbol, count(*) AS n, {s_round('avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END)', 4)} AS hit_rate, {s_round('avg(ret)', 4)} AS mean FROM l GROUP BY GROUPING SETS ((condition, horizon, symbol), (condition, horizon)) HAVING count(*) >= 30",
)
def _(spark, sf):
    return _out(ops.run_suite(_bars(spark, sf), _SUITE), "hit_rate", "mean", keys=("condition", "horizon", "symbol", "n"), digits=4)


_GRID = [2, 3, 4, 5]


@query(
    "param_search",
    f"""WITH {BARS}, f AS (SELECT *, close < {s_lag("close")} AS fell, ({s_lead("close", 5)} / close - 1) * 100 AS ret FROM bars), m AS (SELECT *, {", ".join(f"sum(CASE WHEN fell THEN 1 ELSE 0 END) OVER {s_frame(n)} = {n} AS p{n}" for n in _GRID)} FROM f),
    l AS ({" UNION ALL ".join(f"SELECT 'n={n}' AS params, ret FROM m WHERE p{n} AND ret IS NOT NULL" for n in _GRID)}), g AS (SELECT params, count(*) AS n, avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS hit_rate, avg(ret) AS mean FROM l GROUP BY params)
    SELECT params, n, {s_round("hit_rate", 4)} AS hit_rate, {s_round("mean", 4)} AS mean, {s_round("CASE WHEN mean <= 0 OR n < 5 THEN 0 ELSE mean * hit_rate END", 4)} AS edge FROM g""",
)
def _(spark, sf):
    return _out(ops.param_search(_bars(spark, sf), "consecutive_down", [{"n": n} for n in _GRID]), "hit_rate", "mean", "edge", keys=("params", "n"), digits=4)


_PROMO = f"{LONG}, s AS (SELECT symbol, horizon, {_STATS} FROM l GROUP BY symbol, horizon), q AS (SELECT *, {_SHARPE} FROM s)"


@query(
    "promotion",
    f"""WITH {_PROMO}, w AS (SELECT *, concat_ws('|', CASE WHEN n < 30 THEN 'few_events' END, CASE WHEN hit_rate < 0.55 THEN 'low_hit_rate' END, CASE WHEN coalesce(p_value >= 0.05, true) THEN 'not_significant' END, CASE WHEN mean <= 0 THEN 'no_edge' END) AS reasons FROM q)
    SELECT symbol, horizon, n, reasons, {s_round("least(greatest(mean * hit_rate * 100 * log2(n + 1), 0), 100) * CASE WHEN n >= 300 THEN 1.0 ELSE 0.7 END", 4)} AS promotion_score, reasons = '' AS passed FROM w""",
)
def _(spark, sf):
    return _out(ops.promotion(outcomes.event_stats(_events(spark, sf), ["symbol"]), robust=F.col("n") >= 300), "promotion_score", keys=("symbol", "horizon", "n", "reasons", "passed"), digits=4)


@query(
    "fdr_bh",
    f"""WITH {_PROMO}, r AS (SELECT *, rank() OVER (ORDER BY p_value) + count(*) OVER (PARTITION BY p_value) - 1 AS k, count(*) OVER () AS m FROM q WHERE p_value IS NOT NULL), c AS (SELECT max(CASE WHEN p_value <= k * 1.0 / m * 0.5 THEN p_value END) AS cut FROM r)
    SELECT symbol, horizon, n, {s_round("p_value", 4)} AS p_value, coalesce(p_value <= cut, false) AS significant FROM r, c""",
)
def _(spark, sf):
    out = cross_section.fdr_bh(outcomes.event_stats(_events(spark, sf), ["symbol"]), alpha=0.5)
    return _out(out, "p_value", keys=("symbol", "horizon", "n", "significant"), digits=4)


@query(
    "bootstrap_p",
    f"""WITH {LONG}, u AS (SELECT avg(CASE WHEN fwd_5d > 0 THEN 1 ELSE 0 END) AS p FROM f WHERE fwd_5d IS NOT NULL), g AS (SELECT symbol, count(*) AS n, avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS hit_rate FROM l WHERE horizon = 5 GROUP BY symbol),
    z AS (SELECT symbol, n, hit_rate, (hit_rate * n - 0.5 - n * p) / sqrt(n * p * (1 - p)) AS z FROM g, u) SELECT symbol, n, {s_round("hit_rate", 4)} AS hit_rate, {s_round(f"CASE WHEN z >= 0 THEN ({_tail('z')}) / 2 ELSE 1 - ({_tail('z')}) / 2 END", 4)} AS p_value FROM z""",
)
def _(spark, sf):
    everything = outcomes.forward_returns(_bars(spark, sf), [5]).where("fwd_5d is not null").agg(F.avg((F.col("fwd_5d") > 0).cast("int")).alias("_u"))
    groups = outcomes.event_stats(_events(spark, sf), ["symbol"], [5]).select("symbol", "n", "hit_rate").join(F.broadcast(everything))
    return _out(ops.bootstrap_p(groups, F.col("_u")), "hit_rate", "p_value", keys=("symbol", "n"), digits=4)


_TR = f"""{BARS}, b AS (SELECT *, {s_lag("close")} AS p FROM bars), t AS (SELECT *, CASE WHEN p IS NOT NULL THEN greatest(high - low, abs(high - p), abs(low - p)) END AS tr FROM b),
    a AS (SELECT *, CASE WHEN count(tr) OVER {s_frame(14)} = 14 THEN avg(tr) OVER {s_frame(14)} END AS atr, {", ".join(f"{s_lead('close', h)} AS x{h}" for h in (5, 10, 20))},
          max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS hi, min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS lo,
          CASE WHEN close > p * 1.1 THEN 1 WHEN close < p * 0.9 THEN -1 ELSE 0 END AS d FROM t),
    trades_ AS (SELECT symbol, ts, d AS direction, {", ".join(f"d * (x{h} / close - 1) * 100 AS ret_{h}" for h in (5, 10, 20))}, greatest(CASE WHEN d > 0 THEN hi / close - 1 ELSE 1 - lo / close END, 0) * 100 AS mfe,
          greatest(CASE WHEN d > 0 THEN 1 - lo / close ELSE hi / close - 1 END, 0) * 100 AS mae, atr / close * 100 AS atr_pct FROM a WHERE d <> 0 AND x20 IS NOT NULL),
    tr AS (SELECT *, mae >= 1.5 * atr_pct AS stopped, mfe >= atr_pct AS t1, mfe >= 2 * atr_pct AS t2, mfe >= 3 * atr_pct AS t3 FROM trades_)"""
_NUM = ["ret_5", "ret_10", "ret_20", "mfe", "mae", "atr_pct"]


def _trades(spark, sf):
    bars = features.volatility(_bars(spark, sf))
    before = lag("close")
    signals = bars.select("symbol", "ts", F.when(F.col("close") > before * 1.1, 1).when(F.col("close") < before * 0.9, -1).otherwise(0).alias("direction"))
    return ops.reconstruct_trades(bars, signals)


@query("reconstruct_trades", f"WITH {_TR} SELECT symbol, ts, direction, {', '.join(f'{s_round(c)} AS {c}' for c in _NUM)}, stopped, t1, t2, t3 FROM tr")
def _(spark, sf):
    return _out(_trades(spark, sf), *_NUM, keys=("symbol", "ts", "direction", "stopped", "t1", "t2", "t3"))


_FIRST = "CASE WHEN u > 0 AND t1 THEN u WHEN u > 0 AND stopped THEN -1.5 * u ELSE ret_5 END"
_EXITS = {
    "hold_5": "ret_5", "hold_10": "ret_10", "hold_20": "ret_20", "t1_only": _FIRST,
    "t1_and_runner": "CASE WHEN u > 0 AND t1 THEN 0.5 * u + 0.5 * CASE WHEN t2 THEN 2 * u ELSE greatest(u, ret_5) END WHEN u > 0 AND stopped THEN -1.5 * u ELSE ret_5 END",
    "ladder": "CASE WHEN u > 0 AND t3 THEN (u + 2 * u + 3 * u) / 3 WHEN u > 0 AND t2 THEN (u + 2 * u + ret_5) / 3 WHEN u > 0 AND t1 THEN u / 3 + 2 * ret_5 / 3 WHEN u > 0 AND stopped THEN -1.5 * u ELSE ret_5 END",
    "break_even": "CASE WHEN u > 0 AND t1 THEN greatest(0, ret_5) WHEN u > 0 AND stopped THEN -1.5 * u ELSE ret_5 END",
    "trail": "CASE WHEN u > 0 AND mfe >= 2 * u THEN greatest(ret_5, u) WHEN u > 0 AND mfe >= u THEN greatest(ret_5, 0) ELSE ret_5 END",
    "hold_20_if_high": "CASE WHEN atr_pct >= 30 THEN ret_20 ELSE ret_5 END",
    "tight_stop": f"CASE WHEN u > 0 AND mae >= 0.75 * u AND NOT t1 THEN -0.75 * u ELSE {_FIRST} END",
}


@query("exit_rules", f"WITH {_TR}, e AS ({' UNION ALL '.join(f"SELECT '{n}' AS rule, {c} AS ret FROM (SELECT *, greatest(coalesce(atr_pct, 0), 0) AS u FROM tr)" for n, c in _EXITS.items())}) SELECT rule, count(*) AS n, {s_round('avg(ret)')} AS expectancy, {s_round('avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END)')} AS win_rate FROM e WHERE ret IS NOT NULL GROUP BY rule")
def _(spark, sf):
    out = ops.exit_rules(_trades(spark, sf), F.col("atr_pct") >= 30).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("expectancy"), F.avg((F.col("ret") > 0).cast("int")).alias("win_rate"))
    return _out(out, "expectancy", "win_rate", keys=("rule", "n"))


_MODES = {"stop_before_t1": "stopped AND NOT t1", "t1_then_loss": "t1 AND ret_20 < 0", "flat": "abs(ret_5) < 0.5", "tight_range": "atr_pct < 5"}


@query(
    "failure_modes",
    f"WITH {_TR} " + " UNION ALL ".join(f"SELECT '{n}' AS mode, count(*) FILTER ({c}) AS n, {s_round(f'100.0 * count(*) FILTER ({c}) / count(*)')} AS share_pct, {s_round(f'avg(CASE WHEN {c} THEN ret_5 END)')} AS mean_ret FROM tr" for n, c in _MODES.items()),
)
def _(spark, sf):
    return _out(ops.failure_modes(_trades(spark, sf)), "share_pct", "mean_ret", keys=("mode", "n"))


@query("slippage_sweep", f"WITH {_TR}, s AS (SELECT ret_5 - 2 * bps / 100.0 AS r, CAST(bps AS INT) AS bps FROM tr, (VALUES (0), (10), (25), (50)) v(bps)) SELECT bps, count(*) AS n, {s_round('avg(r)')} AS expectancy, {s_round('avg(CASE WHEN r > 0 THEN 1 ELSE 0 END)')} AS win_rate FROM s GROUP BY bps")
def _(spark, sf):
    return _out(ops.slippage_sweep(_trades(spark, sf)), "expectancy", "win_rate", keys=("bps", "n"))


@query(
    "daily_topn",
    f"WITH {_TR}, k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY atr_pct DESC NULLS LAST, symbol) AS k FROM tr), s AS (SELECT ret_5 AS r, CAST(size AS INT) AS size FROM k, (VALUES (1), (3)) v(size) WHERE k <= size) SELECT size, count(*) AS n, {s_round('avg(r)')} AS expectancy, {s_round('avg(CASE WHEN r > 0 THEN 1 ELSE 0 END)')} AS win_rate FROM s GROUP BY size",
)
def _(spark, sf):
    return _out(ops.daily_topn(_trades(spark, sf), "atr_pct"), "expectancy", "win_rate", keys=("size", "n"))


@query("top_signals", f"WITH {_TR} SELECT symbol, ts, direction, {s_round('atr_pct')} AS atr_pct FROM tr WHERE direction = 1 AND atr_pct >= 10 ORDER BY tr.atr_pct DESC, symbol, ts LIMIT 25")
def _(spark, sf):
    rows = _trades(spark, sf).where("direction = 1 and atr_pct >= 10").orderBy(F.desc("atr_pct"), "symbol", "ts").limit(25)
    return _out(rows, "atr_pct", keys=("symbol", "ts", "direction"))


_AXES = ["symbol", "side", "day"]
_SETS = ", ".join(["(symbol)", "(side)", "(day)", "(symbol, side)", "(symbol, day)", "(side, day)"])
_LABEL = "concat_ws('|', " + ", ".join(f"CASE WHEN grouping({a}) = 0 THEN '{a}=' || coalesce(CAST({a} AS VARCHAR), 'unk') END" for a in _AXES) + ")"


@query(
    "pairwise_slices",
    f"""WITH {_TR}, x AS (SELECT symbol, CASE WHEN direction > 0 THEN 'long' ELSE 'short' END AS side, CAST(isodow(ts) - 1 AS INT) AS day, ret_5 FROM tr)
    SELECT {_LABEL} AS slice, count(*) AS n, {s_round("avg(CASE WHEN ret_5 > 0 THEN 1 ELSE 0 END)")} AS hit_rate, {s_round("avg(ret_5)")} AS expectancy FROM x GROUP BY GROUPING SETS ({_SETS}) HAVING count(*) >= 10""",
)
def _(spark, sf):
    rows = _trades(spark, sf).withColumns({"side": F.when(F.col("direction") > 0, "long").otherwise("short"), "day": F.weekday("ts")})
    return _out(ops.pairwise_slices(rows, _AXES, "ret_5"), "hit_rate", "expectancy", keys=("slice", "n"))


@query(
    "attribution",
    f"WITH {_TR} " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) FILTER (ret_5 > 0) AS n_win, count({c}) FILTER (ret_5 <= 0) AS n_loss, {s_round(f'avg({c}) FILTER (ret_5 > 0)')} AS mean_win, {s_round(f'avg({c}) FILTER (ret_5 <= 0)')} AS mean_loss, "
        + s_round(f"(avg({c}) FILTER (ret_5 > 0) - avg({c}) FILTER (ret_5 <= 0)) / sqrt(((count({c}) FILTER (ret_5 > 0) - 1) * var_samp({c}) FILTER (ret_5 > 0) + (count({c}) FILTER (ret_5 <= 0) - 1) * var_samp({c}) FILTER (ret_5 <= 0)) / (count({c}) - 2))")
        + " AS cohens_d FROM tr"
        for c in ("atr_pct", "mae", "mfe")
    ),
)
def _(spark, sf):
    return _out(ops.attribution(_trades(spark, sf), ["atr_pct", "mae", "mfe"], F.col("ret_5") > 0), "mean_win", "mean_loss", "cohens_d", keys=("feature", "n_win", "n_loss"))


@query(
    "combo_scores",
    f"""WITH {_TR}, x AS (SELECT symbol || '|' || CAST(direction AS VARCHAR) AS combo, ret_5 AS ret FROM tr WHERE ts >= DATE '1999-06-01' - 60 AND ts < DATE '1999-06-01'),
    g AS (SELECT combo, count(*) AS n, avg(ret) AS expectancy, avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS win_rate, coalesce(sum(CASE WHEN ret > 0 THEN ret END), 0) AS w, coalesce(-sum(CASE WHEN ret < 0 THEN ret END), 0) AS l FROM x GROUP BY combo),
    p AS (SELECT *, CASE WHEN l > 0 THEN least(w / l, 5) WHEN w > 0 THEN 5 ELSE 0 END AS pf FROM g), r AS (SELECT *, pf * expectancy * log2(n + 1) AS raw FROM p), s AS (SELECT *, max(raw) OVER () AS top FROM r)
    SELECT combo, n, {s_round("expectancy")} AS expectancy, {s_round("win_rate")} AS win_rate, {s_round("pf")} AS profit_factor, {s_round("CASE WHEN top > 0 THEN greatest(raw / top * 100, 0) ELSE 0 END")} AS meta_score FROM s""",
)
def _(spark, sf):
    rows = _trades(spark, sf).select("ts", F.concat_ws("|", "symbol", F.col("direction").cast("string")).alias("combo"), F.col("ret_5").alias("ret"))
    return _out(ops.combo_scores(rows, "combo", "1999-06-01"), "expectancy", "win_rate", "profit_factor", "meta_score", keys=("combo", "n"))


@query(
    "confidence_buckets",
    f"""WITH {_TR}, h AS (SELECT symbol, direction, CASE WHEN ret_5 > 0 THEN 1.0 ELSE 0.0 END AS hit FROM tr), u AS (SELECT avg(hit) AS base FROM h), g AS (SELECT symbol, direction, count(*) AS n, (sum(hit) + 50 * any_value(base)) / (count(*) + 50) AS accuracy, any_value(base) AS base FROM h, u GROUP BY symbol, direction)
    SELECT symbol, direction, n, {s_round("accuracy")} AS accuracy, {s_round("least(greatest(accuracy / base, 0.5), 1.5)")} AS multiplier FROM g""",
)
def _(spark, sf):
    rows = _trades(spark, sf).withColumn("hit", (F.col("ret_5") > 0).cast("double"))
    return _out(ops.confidence_buckets(rows, ["symbol", "direction"], "hit"), "accuracy", "multiplier", keys=("symbol", "direction", "n"))
