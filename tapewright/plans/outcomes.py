"""Queries over forward returns, events and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import rounded
from ..operators import conditions, outcomes as ops
from .features import _bars, _out
from .registry import BARS, W, query, s_frame, s_lag, s_lead, s_round

H = ops.HORIZONS
_FWD = ", ".join(f"({s_lead('close', h)} / close - 1) * 100 AS fwd_{h}d" for h in H)
_PATH = ", ".join(
    f"(max(high) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {w} FOLLOWING) / close - 1) * 100 AS max_runup_{w}d, (min(low) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {w} FOLLOWING) / close - 1) * 100 AS max_drawdown_{w}d"
    for w in (5, 20)
)
#: Three falling closes, with the returns and paths after them.
EVENTS = f"""{BARS}, f AS (SELECT *, close < {s_lag("close")} AS fell, {_FWD}, {_PATH} FROM bars),
    m AS (SELECT *, sum(CASE WHEN fell THEN 1 ELSE 0 END) OVER {s_frame(3)} = 3 AS signal FROM f),
    events_ AS (SELECT * FROM m WHERE signal AND fwd_20d IS NOT NULL)"""
LONG = EVENTS + ", l AS (" + " UNION ALL ".join(f"SELECT symbol, ts, {h} AS horizon, fwd_{h}d AS ret FROM events_ WHERE fwd_{h}d IS NOT NULL" for h in H) + ")"


def _events(spark, sf):
    return ops.signal_events(conditions.evaluate(_bars(spark, sf), "consecutive_down", n=3))


@query("forward_returns", f"WITH {BARS}, f AS (SELECT symbol, ts, {_FWD} FROM bars) SELECT symbol, ts, {', '.join(f'{s_round(f'fwd_{h}d')} AS fwd_{h}d' for h in H)} FROM f")
def _(spark, sf):
    return _out(ops.forward_returns(_bars(spark, sf)), *[f"fwd_{h}d" for h in H])


_PATHS = [f"max_{k}_{w}d" for w in (5, 20) for k in ("runup", "drawdown")]


@query("path_stats", f"WITH {BARS}, f AS (SELECT symbol, ts, {_PATH} FROM bars) SELECT symbol, ts, {', '.join(f'{s_round(c)} AS {c}' for c in _PATHS)} FROM f")
def _(spark, sf):
    return _out(ops.path_stats(_bars(spark, sf)), *_PATHS)


_LAB = ", ".join(f"ln({s_lead('close', h)} / close) AS return_{h}d" for h in (1, 5, 10, 20, 60))


@query(
    "forward_labels",
    f"""WITH {BARS}, f AS (SELECT symbol, ts, {_LAB}, ln(max(high) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) / close) AS up, ln(min(low) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) / close) AS down FROM bars)
    SELECT symbol, ts, {", ".join(f"{s_round(f'return_{h}d')} AS return_{h}d, return_{h}d > 0 AS positive_{h}d" for h in (1, 5, 10, 20, 60))}, {s_round("up")} AS max_runup_20d, {s_round("down")} AS max_drawdown_20d
    FROM f WHERE return_60d IS NOT NULL""",
)
def _(spark, sf):
    out = ops.forward_labels(_bars(spark, sf))
    number = [f"return_{h}d" for h in (1, 5, 10, 20, 60)] + ["max_runup_20d", "max_drawdown_20d"]
    return out.select("symbol", "ts", *[rounded(F.col(c)).alias(c) for c in number], *[f"positive_{h}d" for h in (1, 5, 10, 20, 60)])


@query("signal_events", f"WITH {EVENTS} SELECT symbol, ts, {', '.join(f'{s_round(c)} AS {c}' for c in [f'fwd_{h}d' for h in H] + _PATHS)} FROM events_")
def _(spark, sf):
    return _out(_events(spark, sf), *[f"fwd_{h}d" for h in H], *_PATHS)


#: P(|Z| > z) by the same published polynomial.
def _tail(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    poly = f"({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"2 * exp(-({z}) * ({z}) / 2) / sqrt(2 * 3.141592653589793) * {poly}"


_STATS = f"""count(*) AS n, avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS hit_rate, avg(ret) AS mean, quantile_cont(ret, 0.5) AS median,
    CASE WHEN count(*) > 1 THEN stddev_samp(ret) END AS std, quantile_cont(ret, 0.25) AS p25, quantile_cont(ret, 0.75) AS p75"""
_SHOWN = ["hit_rate", "mean", "median", "std", "p25", "p75", "sharpe", "p_value"]
_SHARPE = f"CASE WHEN std > 0 THEN mean / std * sqrt(252.0 / horizon) END AS sharpe, CASE WHEN n > 1 AND std > 0 THEN {_tail('(mean / (std / sqrt(n)))')} END AS p_value"


@query("event_stats", f"WITH {LONG}, s AS (SELECT horizon, {_STATS} FROM l GROUP BY horizon), q AS (SELECT *, {_SHARPE} FROM s) SELECT horizon, n, {', '.join(f'{s_round(c, 4)} AS {c}' for c in _SHOWN)} FROM q")
def _(spark, sf):
    return _out(ops.event_stats(_events(spark, sf)), *_SHOWN, keys=("horizon", "n"), digits=4)


@query(
    "event_stats_by_symbol",
    f"WITH {LONG}, s AS (SELECT symbol, horizon, {_STATS} FROM l GROUP BY symbol, horizon), q AS (SELECT *, {_SHARPE} FROM s) SELECT symbol, horizon, n, {', '.join(f'{s_round(c, 4)} AS {c}' for c in _SHOWN)} FROM q",
)
def _(spark, sf):
    return _out(ops.event_stats(_events(spark, sf), ["symbol"]), *_SHOWN, keys=("symbol", "horizon", "n"), digits=4)


@query(
    "yearly_breakdown",
    f"""WITH {EVENTS} SELECT symbol, CAST(year(ts) AS INT) AS year, count(*) AS n, {s_round("avg(CASE WHEN fwd_5d > 0 THEN 1 ELSE 0 END)", 4)} AS hit_rate, {s_round("avg(fwd_5d)", 4)} AS mean
    FROM events_ WHERE fwd_5d IS NOT NULL GROUP BY symbol, year(ts) HAVING count(*) >= 3""",
)
def _(spark, sf):
    return _out(ops.yearly_breakdown(_events(spark, sf), 5, ["symbol"]), "hit_rate", "mean", keys=("symbol", "year", "n"), digits=4)


@query(
    "robustness",
    f"""WITH {EVENTS}, r AS (SELECT symbol, year(ts) AS year, fwd_5d AS ret FROM events_ WHERE fwd_5d IS NOT NULL),
    y AS (SELECT symbol, year, sum(ret) AS s, count(*) AS k FROM r GROUP BY symbol, year),
    b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY s / k DESC, year DESC) AS place FROM y),
    t AS (SELECT symbol, sum(s) AS s, CAST(sum(k) AS BIGINT) AS n, count(*) AS years, sum(CASE WHEN place > 1 THEN s END) / sum(CASE WHEN place > 1 THEN k END) AS rest FROM b GROUP BY symbol),
    c AS (SELECT symbol, quantile_cont(ret, 0.05) AS lo, quantile_cont(ret, 0.95) AS hi FROM r GROUP BY symbol),
    w AS (SELECT symbol, avg(least(greatest(ret, lo), hi)) AS wins FROM r JOIN c USING (symbol) GROUP BY symbol)
    SELECT symbol, n, years, {s_round("s / n", 4)} AS mean, {s_round("rest", 4)} AS mean_without_best, {s_round("wins", 4)} AS mean_winsorised,
           ((n >= 30)::INT + (years >= 3)::INT + coalesce(rest > 0, false)::INT + coalesce(wins > 0, false)::INT) / 4.0::DOUBLE AS score FROM t JOIN w USING (symbol)""",
)
def _(spark, sf):
    out = ops.robustness(_events(spark, sf), 5, ["symbol"])
    return out.select("symbol", "n", "years", *[rounded(F.col(c), 4).alias(c) for c in ("mean", "mean_without_best", "mean_winsorised")], F.col("score").cast("double").alias("score"))


@query(
    "signal_status",
    f"""WITH {LONG}, y AS (SELECT symbol, horizon, count(DISTINCT year(ts)) AS years FROM l GROUP BY symbol, horizon), s AS (SELECT symbol, horizon, {_STATS} FROM l GROUP BY symbol, horizon),
    q AS (SELECT *, {_SHARPE} FROM s JOIN y USING (symbol, horizon))
    SELECT symbol, horizon, n, years, CASE WHEN n >= 50 AND hit_rate > 0.54 AND p_value < 0.05 AND years >= 3 THEN 'promoted' WHEN n >= 20 AND hit_rate > 0.52 AND p_value < 0.10 THEN 'candidate' ELSE 'rejected' END AS status FROM q""",
)
def _(spark, sf):
    events = _events(spark, sf)
    years = ops.long_outcomes(events, ["symbol", "ts"]).groupBy("symbol", "horizon").agg(F.countDistinct(F.year("ts")).alias("years"))
    out = ops.event_stats(events, ["symbol"]).join(years, ["symbol", "horizon"])
    return out.select("symbol", "horizon", "n", "years", ops.classify_status(F.col("n"), F.col("hit_rate"), F.col("p_value"), F.col("years")).alias("status"))


_METRICS = ["win_rate", "expectancy", "avg_win", "avg_loss", "max_drawdown", "profit_factor"]
_METRICS_SQL = f"""r AS (SELECT *, sum(ret) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM trades_), x AS (SELECT *, greatest(max(run) OVER (PARTITION BY symbol ORDER BY ts), 0) AS top FROM r),
    g AS (SELECT symbol, count(*) AS n, avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS win_rate, avg(ret) AS expectancy, coalesce(sum(CASE WHEN ret > 0 THEN ret END), 0) AS w, coalesce(-sum(CASE WHEN ret <= 0 THEN ret END), 0) AS l,
          avg(CASE WHEN ret > 0 THEN ret END) AS avg_win, avg(CASE WHEN ret <= 0 THEN ret END) AS avg_loss, max(top - run) AS max_drawdown FROM x GROUP BY symbol),
    p AS (SELECT *, CASE WHEN l > 0 THEN least(w / l, 5) WHEN w > 0 THEN 5.0 ELSE 0.0 END AS profit_factor FROM g)
    SELECT symbol, n, {", ".join(f"{s_round(c, 4)} AS {c}" for c in _METRICS)} FROM p"""


@query("trade_metrics", f"WITH {EVENTS}, trades_ AS (SELECT symbol, ts, fwd_5d AS ret FROM events_), {_METRICS_SQL}")
def _(spark, sf):
    trades = _events(spark, sf).select("symbol", "ts", F.col("fwd_5d").alias("ret"))
    return _out(ops.trade_metrics(trades, ["symbol"]), *_METRICS, keys=("symbol", "n"), digits=4)


@query(
    "chrono_split",
    f"WITH {EVENTS}, s AS (SELECT symbol, ts, row_number() OVER ({W}) <= floor(count(*) OVER (PARTITION BY symbol) * 0.7) AS in_sample FROM events_) SELECT symbol, ts, in_sample FROM s",
)
def _(spark, sf):
    return ops.chrono_split(_events(spark, sf), ["symbol"]).select("symbol", "ts", "in_sample")


@query(
    "percentile_labels",
    f"""WITH {BARS}, r AS (SELECT symbol, ts, close / open - 1 AS br FROM bars), c AS (SELECT symbol, quantile_cont(br, 0.1) AS lo, quantile_cont(br, 0.9) AS hi FROM r GROUP BY symbol)
    SELECT symbol, ts, {s_round("br")} AS bar_return, CASE WHEN br >= hi THEN 'rise' WHEN br <= lo THEN 'drop' ELSE 'none' END AS label FROM r JOIN c USING (symbol)""",
)
def _(spark, sf):
    return ops.percentile_labels(_bars(spark, sf)).select("symbol", "ts", rounded(F.col("bar_return")).alias("bar_return"), "label")


@query(
    "position_segments",
    f"""WITH {BARS}, a AS (SELECT *, CASE WHEN count(*) OVER {s_frame(30)} = 30 THEN avg(close) OVER {s_frame(10)} END AS f, CASE WHEN count(*) OVER {s_frame(30)} = 30 THEN avg(close) OVER {s_frame(30)} END AS s FROM bars),
    d AS (SELECT *, CASE WHEN f > s THEN 1 WHEN f < s THEN -1 END AS side FROM a), k AS (SELECT * FROM d WHERE side IS NOT NULL), t AS (SELECT *, CASE WHEN side = {s_lag("side")} THEN 0 ELSE 1 END AS turn FROM k),
    g AS (SELECT *, CAST(sum(turn) OVER ({W}) AS BIGINT) AS segment FROM t)
    SELECT symbol, segment, first(side) AS side, min(ts) AS entry_ts, max(ts) AS exit_ts, {s_round("arg_min(close, ts)", 4)} AS entry, {s_round("arg_max(close, ts)", 4)} AS exit, count(*) AS n_bars,
           {s_round("first(side) * (arg_max(close, ts) / arg_min(close, ts) - 1) * 100", 4)} AS ret FROM g GROUP BY symbol, segment""",
)
def _(spark, sf):
    return _out(ops.position_segments(_bars(spark, sf)), "entry", "exit", "ret", keys=("symbol", "segment", "side", "entry_ts", "exit_ts", "n_bars"), digits=4)
