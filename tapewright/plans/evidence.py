"""Queries over evidence: draws, slices, rules, hypotheses, retraining, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import frame, lag, lead, rounded
from ..operators import conditions, evidence as ops, features, outcomes
from .features import MARKET, _bars, _out
from ..sources.written import written
from .matrix import _PARTS, _VOTE, _voted
from .outcomes import LONG, _events
from .patterns import PATTERNS
from .registry import BARS, query, s_frame, s_lag, s_lead, s_round

_SIG = f"""{BARS}, f AS (SELECT *, close < {s_lag("close")} AS fell, ({s_lead("close", 5)} / close - 1) * 100 AS fwd, ln(close / {s_lag("close", 20)}) AS r20 FROM bars),
    m AS (SELECT symbol, ts, coalesce(sum(CASE WHEN fell THEN 1 ELSE 0 END) OVER {s_frame(3)} = 3, false) AS on_, fwd, r20 FROM f)"""


def _draws(on: str, y: str) -> str:
    return f"""kn AS (SELECT symbol, ts, {on} AS on_, {y} AS y FROM m WHERE fwd IS NOT NULL), sz AS (SELECT count(*) FILTER (on_) AS k, avg(y) FILTER (on_) AS observed FROM kn),
    dr AS (SELECT d.draw, y, row_number() OVER (PARTITION BY d.draw ORDER BY md5(d.draw || '|' || symbol || '|' || CAST(ts AS VARCHAR))) AS r FROM kn, (SELECT unnest(range(50)) AS draw) d),
    nl AS (SELECT draw, avg(y) AS rate FROM dr, sz WHERE r <= k GROUP BY draw)
    SELECT k, {s_round("observed")} AS observed, {s_round("avg(rate)")} AS null_mean, {s_round("stddev_samp(rate)")} AS null_std, {s_round("quantile_cont(rate, 0.95)")} AS null_p95,
           {s_round("avg(CASE WHEN round(rate, 12) >= round(observed, 12) THEN 1.0 ELSE 0.0 END)")} AS p_value, observed > quantile_cont(rate, 0.95) AS passed FROM nl, sz GROUP BY k, observed"""


_PT = ("observed", "null_mean", "null_std", "null_p95", "p_value")


@query("permutation_test", f"WITH {_SIG}, {_draws('on_', 'CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END')}")
def _(spark, sf):
    rows = outcomes.forward_returns(conditions.evaluate(_bars(spark, sf), "consecutive_down", n=3), [5])
    return _out(ops.permutation_test(rows, "signal", "fwd_5d"), *_PT, keys=("k", "passed"))


@query("label_shuffle_test", f"WITH {_SIG}, {_draws('coalesce(r20 >= 0.1, false)', 'fwd')}")
def _(spark, sf):
    rows = outcomes.forward_returns(_bars(spark, sf).withColumn("r20", features.log_return(20)), [5])
    return _out(ops.label_shuffle_test(rows, "r20", 0.1, "fwd_5d"), *_PT, keys=("k", "passed"))


@query(
    "exact_binomial_p",
    f"""WITH {LONG}, g AS (SELECT symbol, horizon, count(*) AS n, count(*) FILTER (ret > 0) AS k FROM l GROUP BY symbol, horizon)
    SELECT symbol, horizon, n, k, {s_round("(SELECT least(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))), 1) FROM (SELECT unnest(generate_series(k, n)) AS i))")} AS p_value FROM g""",
)
def _(spark, sf):
    rows = outcomes.long_outcomes(_events(spark, sf), ["symbol"]).where("ret is not null")
    out = rows.groupBy("symbol", "horizon").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ret") > 0).alias("k"))
    return _out(out.withColumn("p_value", ops.exact_binomial_p(F.col("n"), F.col("k"))), "p_value", keys=("symbol", "horizon", "n", "k"))


@query(
    "fisher_combine",
    f"""WITH {LONG}, g AS (SELECT symbol, horizon, count(*) AS n, count(*) FILTER (ret > 0) AS k, avg(ret) AS mean FROM l GROUP BY symbol, horizon),
    p AS (SELECT *, (SELECT least(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))), 1) FROM (SELECT unnest(generate_series(k, n)) AS i)) AS p_value FROM g),
    c AS (SELECT horizon, count(*) AS groups, CAST(sum(n) AS BIGINT) AS n, sum(k) / sum(n) AS hit_rate, sum(n * mean) / sum(n) AS mean, -2 * sum(ln(greatest(p_value, 1e-12))) AS chi2 FROM p GROUP BY horizon)
    SELECT horizon, groups, n, {s_round("hit_rate")} AS hit_rate, {s_round("mean")} AS mean, {s_round("chi2", 4)} AS chi2,
           {s_round("exp(-chi2 / 2) * (SELECT sum(exp(i * ln(chi2 / 2) - lgamma(i + 1))) FROM (SELECT unnest(range(groups)) AS i))")} AS combined_p FROM c""",
)
def _(spark, sf):
    rows = outcomes.long_outcomes(_events(spark, sf), ["symbol"]).where("ret is not null")
    stats = rows.groupBy("symbol", "horizon").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ret") > 0).alias("k"), F.avg("ret").alias("mean"))
    stats = stats.withColumns({"hit_rate": F.col("k") / F.col("n"), "p_value": ops.exact_binomial_p(F.col("n"), F.col("k"))})
    out = ops.fisher_combine(stats, ["horizon"])
    return out.select("horizon", "groups", "n", *[rounded(F.col(c)).alias(c) for c in ("hit_rate", "mean", "combined_p")], rounded(F.col("chi2"), 4).alias("chi2"))


#: Calls on bars with a jump: long after a fall, short after a rise, with the context of the day.
_CALLS = f"""{BARS}, {MARKET}, mk AS (SELECT ts, CASE WHEN b > avg(b) OVER (ORDER BY ts ROWS 49 PRECEDING) THEN 'bull' ELSE 'bear' END AS regime FROM market),
    q AS (SELECT *, {s_lag("close")} AS p, {s_lead("close", 5)} AS x, avg(volume) OVER {s_frame(20)} AS va, avg(close) OVER {s_frame(20)} AS ca FROM bars),
    c0 AS (SELECT symbol, ts, CASE WHEN close < p * 0.95 THEN 'dip' ELSE 'spike' END AS setup, CASE WHEN close < p * 0.95 THEN 1 ELSE -1 END * (x / close - 1) * 100 AS ret,
                  volume / va AS vol_ratio, close / ca - 1 AS from_mean, open / p - 1 AS gap, isodow(ts) - 1 AS weekday FROM q WHERE (close < p * 0.95 OR close > p * 1.05) AND x IS NOT NULL),
    c1 AS (SELECT c0.*, regime, row_number() OVER (PARTITION BY setup ORDER BY ts, symbol) <= floor(count(*) OVER (PARTITION BY setup) * 0.7) AS in_sample, ret - 0.05 AS r FROM c0 JOIN mk USING (ts))"""
_BAND = "CASE WHEN vol_ratio > 1.5 THEN 'high' WHEN vol_ratio < 0.8 THEN 'low' ELSE 'normal' END"
_GAPS = "CASE WHEN gap > 0.003 THEN 'up' WHEN gap < -0.003 THEN 'down' ELSE 'flat' END"
_PF = lambda f="true": f"CASE WHEN count(*) FILTER ({f}) = 0 THEN 0 WHEN coalesce(-sum(r) FILTER (r <= 0 AND {f}), 0) = 0 THEN CASE WHEN coalesce(sum(r) FILTER (r > 0 AND {f}), 0) > 0 THEN 5 ELSE 1 END ELSE least(5, coalesce(sum(r) FILTER (r > 0 AND {f}), 0) / -sum(r) FILTER (r <= 0 AND {f})) END"
_MET = lambda s, f: f"count(*) FILTER ({f}) AS n{s}, coalesce(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) FILTER ({f}), 0) AS wr{s}, coalesce(avg(r) FILTER ({f}), 0) AS exp{s}, {_PF(f)} AS pf{s}"


def _calls(spark, sf):
    bars = _bars(spark, sf)
    market = features.market_bar(bars)
    regime = market.withColumn("regime", F.when(F.col("close") > F.avg("close").over(frame(50)), "bull").otherwise("bear")).select("ts", "regime")
    before = lag("close")
    rows = bars.withColumns({"p": before, "x": lead("close", 5), "va": F.avg("volume").over(frame(20)), "ca": F.avg("close").over(frame(20))})
    rows = rows.where("(close < p * 0.95 or close > p * 1.05) and x is not null")
    dip = F.col("close") < F.col("p") * 0.95
    rows = rows.select(
        "symbol", "ts", F.when(dip, "dip").otherwise("spike").alias("setup"), (F.when(dip, 1).otherwise(-1) * (F.col("x") / F.col("close") - 1) * 100).alias("ret"), (F.col("volume") / F.col("va")).alias("vol_ratio"),
        (F.col("close") / F.col("ca") - 1).alias("from_mean"), (F.col("open") / F.col("p") - 1).alias("gap"), F.weekday("ts").alias("weekday"),
    )
    return outcomes.chrono_split(rows.join(regime, "ts"), ["setup"])


def _slices():
    band = F.when(F.col("vol_ratio") > 1.5, "high").when(F.col("vol_ratio") < 0.8, "low").otherwise("normal")
    gap = F.when(F.col("gap") > 0.003, "up").when(F.col("gap") < -0.003, "down").otherwise("flat")
    return {"regime": F.col("regime"), "weekday": F.col("weekday"), "symbol": F.col("symbol"), "volume": band, "gap": gap, "setup": F.col("setup")}


_SL = f"SELECT 'regime' AS slice, regime AS value, r FROM c1 UNION ALL SELECT 'weekday', CAST(weekday AS VARCHAR), r FROM c1 UNION ALL SELECT 'symbol', symbol, r FROM c1 UNION ALL SELECT 'volume', {_BAND}, r FROM c1 UNION ALL SELECT 'gap', {_GAPS}, r FROM c1 UNION ALL SELECT 'setup', setup, r FROM c1"


@query("slice_metrics", f"WITH {_CALLS}, s AS ({_SL}) SELECT slice, value, count(*) AS n, {s_round('avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END)')} AS wr, {s_round('avg(r)')} AS exp, {s_round(_PF())} AS pf FROM s GROUP BY slice, value")
def _(spark, sf):
    return _out(ops.slice_metrics(_calls(spark, sf), _slices()), "wr", "exp", "pf", keys=("slice", "value", "n"))


_IS, _OOS = "in_sample", "NOT in_sample"
_M8 = [f"{m}{s}" for s in ("_is", "_oos") for m in ("wr", "exp", "pf")]


@query(
    "setup_status",
    f"""WITH {_CALLS}, g AS (SELECT setup, {_MET("_is", _IS)}, {_MET("_oos", _OOS)} FROM c1 GROUP BY setup),
    cx AS (SELECT setup, 'regime=' || regime AS context, r FROM c1 UNION ALL SELECT setup, 'weekday=' || weekday, r FROM c1), ca AS (SELECT setup, context, round(avg(r), 9) AS e FROM cx GROUP BY setup, context HAVING count(*) >= 10),
    b AS (SELECT setup, first(context ORDER BY e DESC, context DESC) AS best_context, max(e) AS best_exp FROM ca GROUP BY setup)
    SELECT g.setup, n_is, n_oos, {", ".join(f"{s_round(c)} AS {c}" for c in _M8)}, best_context, {s_round("best_exp")} AS best_exp,
           CASE WHEN n_is < 30 THEN 'collecting' WHEN n_oos >= 10 AND exp_oos < -0.05 AND pf_oos < 0.9 THEN 'rejected' WHEN NOT (wr_is >= 0.5 AND exp_is >= 0.1 AND pf_is >= 1.2) THEN 'collecting'
                WHEN n_oos >= 10 AND wr_oos >= 0.47 AND exp_oos >= 0.05 AND pf_oos >= 1.1 THEN 'promoted' ELSE 'candidate' END AS status FROM g LEFT JOIN b USING (setup)""",
)
def _(spark, sf):
    found = ops.setup_status(_calls(spark, sf), "setup", {n: _slices()[n] for n in ("regime", "weekday")})
    return _out(found, *_M8, "best_exp", keys=("setup", "n_is", "n_oos", "best_context", "status"))


_RULES = {
    "high_volume": "vol_ratio > 1.5", "very_high_volume": "vol_ratio > 2.0", "low_volume": "vol_ratio < 0.8", "above_mean": "from_mean > 0", "below_mean": "from_mean < 0", "near_mean": "abs(from_mean) < 0.0015",
    "gap_up": "gap > 0.003", "gap_down": "gap < -0.003", "flat_open": "abs(gap) < 0.0015", "regime_bull": "regime = 'bull'", "regime_bear": "regime = 'bear'", "week_start": "weekday <= 1", "week_end": "weekday >= 3",
}
_COMBOS = [("high_volume", "above_mean"), ("high_volume", "regime_bull"), ("high_volume", "regime_bear"), ("gap_up", "above_mean"), ("gap_down", "below_mean"), ("low_volume", "regime_bull"), ("below_mean", "regime_bear")]
_LR = " UNION ALL ".join(["SELECT *, 'all' AS rule FROM c1", *[f"SELECT *, '{n}' FROM c1 WHERE {r}" for n, r in _RULES.items()], *[f"SELECT *, '{a}+{b}' FROM c1 WHERE {_RULES[a]} AND {_RULES[b]}" for a, b in _COMBOS]])


@query(
    "refine_rules",
    f"""WITH {_CALLS}, lr AS ({_LR}), g AS (SELECT setup, rule, {_MET("_is", _IS)}, {_MET("_oos", _OOS)}, count(*) AS n, sum(r) AS s, max(r) AS top, count(DISTINCT date_trunc('week', ts)) AS weeks FROM lr GROUP BY setup, rule),
    sy AS (SELECT setup, rule, count(*) FILTER (m >= 3) AS symbols FROM (SELECT setup, rule, symbol, count(*) AS m FROM lr GROUP BY ALL) GROUP BY setup, rule),
    h AS (SELECT g.*, symbols, CASE WHEN n < 3 THEN 1 WHEN s / n <= 0 THEN 0 ELSE greatest(0, (s / n - (s - top) / (n - 1)) / abs(s / n)) END AS sensitivity FROM g JOIN sy USING (setup, rule)),
    b AS (SELECT setup, exp_is AS base_exp_is, pf_oos AS base_pf_oos FROM h WHERE rule = 'all')
    SELECT setup, rule, n_is, n_oos, {", ".join(f"{s_round(c)} AS {c}" for c in _M8)}, weeks, symbols, {s_round("sensitivity")} AS sensitivity,
           CASE WHEN n_is < 20 OR n_oos < 5 OR exp_oos <= 0 OR pf_oos <= base_pf_oos OR symbols < 3 OR weeks < 3 OR sensitivity > 0.4 THEN 'rejected' WHEN exp_is > base_exp_is THEN 'promoted' ELSE 'candidate' END AS status
    FROM h JOIN b USING (setup) WHERE rule <> 'all'""",
)
def _(spark, sf):
    found = ops.refine_rules(_calls(spark, sf), "setup", {n: F.expr(r) for n, r in _RULES.items()}, _COMBOS)
    return _out(found, *_M8, "sensitivity", keys=("setup", "rule", "n_is", "n_oos", "weeks", "symbols", "status"))


@query(
    "resolve_pending",
    f"""WITH {BARS}, s AS (SELECT symbol, ts, CASE WHEN ts < DATE '1997-01-01' THEN 1.5 END AS k1, CASE WHEN ts < DATE '1996-01-01' THEN -2.5 END AS k5, {s_lead("close", 1)} / close - 1 AS f1, {s_lead("close", 5)} / close - 1 AS f5 FROM bars)
    SELECT symbol, ts, {s_round("coalesce(k1, f1 * 100)")} AS ret_1d, {s_round("coalesce(k5, f5 * 100)")} AS ret_5d, coalesce(k5, f5) IS NOT NULL AS resolved FROM s""",
)
def _(spark, sf):
    bars = _bars(spark, sf)
    known = lambda cut, v: F.when(F.col("ts") < F.lit(cut).cast("date"), v)
    signals = bars.select("symbol", "ts", known("1997-01-01", 1.5).alias("ret_1d"), known("1996-01-01", -2.5).alias("ret_5d"))
    return _out(ops.resolve_pending(signals, bars, [1, 5]), "ret_1d", "ret_5d", keys=("symbol", "ts", "resolved"))


@query(
    "attach_combo_scores",
    f"""WITH {_CALLS}, k AS (SELECT *, 'setup=' || setup || '|regime=' || regime AS key, CAST(date_trunc('month', ts) AS DATE) AS month FROM c1),
    sc AS (SELECT key, month, avg(ret) AS score, count(*) AS n FROM k GROUP BY key, month), lt AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY key ORDER BY month DESC) = 1)
    SELECT k.symbol, k.ts, k.setup, lt.month AS score_month, {s_round("lt.score")} AS score, lt.n FROM k LEFT JOIN lt USING (key)""",
)
def _(spark, sf):
    key = F.concat(F.lit("setup="), "setup", F.lit("|regime="), "regime")
    rows = _calls(spark, sf).withColumns({"key": key, "month": F.trunc("ts", "month")})
    scores = rows.groupBy("key", "month").agg(F.avg("ret").alias("score"), F.count(F.lit(1)).alias("n"))
    return _out(ops.attach_latest(rows.drop("month"), scores, "key", "month"), "score", keys=("symbol", "ts", "setup", "score_month", "n"))


_HYP = f"""{_CALLS}, hx AS (SELECT setup || '_' || weekday AS hypothesis, setup, symbol, ts, ret AS raw, CASE WHEN setup = 'spike' THEN -ret ELSE ret END AS y, regime FROM c1),
    rk AS (SELECT *, rank() OVER (PARTITION BY hypothesis ORDER BY ts) + (count(*) OVER (PARTITION BY hypothesis, ts) - 1) / 2.0 AS rt, rank() OVER (PARTITION BY hypothesis ORDER BY raw) + (count(*) OVER (PARTITION BY hypothesis, raw) - 1) / 2.0 AS rr,
                  sum(y) OVER (PARTITION BY hypothesis ORDER BY ts, symbol ROWS UNBOUNDED PRECEDING) AS cum FROM hx),
    dd AS (SELECT *, max(cum) OVER (PARTITION BY hypothesis ORDER BY ts, symbol ROWS UNBOUNDED PRECEDING) - cum AS fall FROM rk),
    hs AS (SELECT hypothesis, 5 AS horizon, count(*) AS n, avg(y) AS mean, quantile_cont(y, 0.5) AS median, stddev_samp(y) AS std, avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, max(fall) AS max_drawdown,
                  CASE WHEN count(DISTINCT symbol) > 1 THEN corr(rt, rr) END AS rank_ic, count(*) FILTER (regime = 'bull') AS n_bull, count(*) FILTER (regime = 'bear') AS n_bear FROM dd GROUP BY hypothesis HAVING count(*) >= 15),
    h2 AS (SELECT *, mean / (std / sqrt(n)) AS t_stat, mean / std * sqrt(252 / 5.0) AS sharpe FROM hs),
    h3 AS (SELECT *, 0.3 * greatest(0, (hit_rate - 0.5) / 0.5) + 0.35 * greatest(0, least(1, sharpe / 2)) + 0.25 * greatest(0, least(1, coalesce(rank_ic, 0) / 0.1)) + 0.1 * least(1, log10(n) / log10(200)) AS composite FROM h2)"""
_HN = ("mean", "median", "std", "hit_rate", "max_drawdown", "rank_ic", "t_stat", "sharpe", "composite")


def _hypotheses(spark, sf):
    rows = _calls(spark, sf).withColumn("hypothesis", F.concat("setup", F.lit("_"), F.col("weekday").cast("string")))
    return ops.hypothesis_stats(rows, ["hypothesis"], "ret", 5, "regime", F.col("setup") == "spike").withColumn("horizon", F.lit(5))


@query("hypothesis_stats", f"WITH {_HYP} SELECT hypothesis, horizon, n, n_bull, n_bear, {', '.join(f'{s_round(c, 5)} AS {c}' for c in _HN)} FROM h3")
def _(spark, sf):
    return _out(_hypotheses(spark, sf), *_HN, keys=("hypothesis", "horizon", "n", "n_bull", "n_bear"), digits=5)


@query(
    "hypothesis_leaderboard",
    f"""WITH {_HYP} SELECT hypothesis, horizon, n, 'weekday ' || right(hypothesis, 1) AS claim, {s_round("composite", 5)} AS composite, CAST(row_number() OVER (ORDER BY round(composite, 9) DESC, hypothesis) AS INT) AS rank FROM h3 WHERE abs(t_stat) > 0.2""",
)
def _(spark, sf):
    stats = _hypotheses(spark, sf).where(F.abs("t_stat") > 0.2).withColumn("p_value", F.lit(None).cast("double"))
    claims = stats.select("hypothesis", F.concat(F.lit("weekday "), F.substring("hypothesis", -1, 1)).alias("claim"))
    return _out(ops.hypothesis_leaderboard(stats, claims, "hypothesis"), "composite", keys=("hypothesis", "horizon", "n", "claim", "rank"), digits=5)


@query(
    "promote_hypotheses",
    f"""WITH {_HYP} SELECT hypothesis, horizon, n, {s_round("composite", 5)} AS composite, n >= 20 AND hit_rate >= 0.5 AND composite >= 0.1 AND abs(t_stat) >= 0.5 AS promoted, lower(hypothesis) || '_h5' AS feature_name FROM h3""",
)
def _(spark, sf):
    stats = _hypotheses(spark, sf).withColumn("p_value", F.when(F.abs("t_stat") >= 0.5, 0.05).otherwise(0.5))
    return _out(ops.promote_hypotheses(stats, "hypothesis", hit=0.5, composite=0.1), "composite", keys=("hypothesis", "horizon", "n", "promoted", "feature_name"), digits=5)


_CHECKS = f"""{_CALLS}, d AS (SELECT max(ts) AS now FROM c1),
    ck AS (SELECT date_diff('day', DATE '1998-06-01', now) AS days_since, (SELECT corr(from_mean, ret) FROM c1, d WHERE ts > now - INTERVAL 20 DAY) AS ic_20d,
        (SELECT count(*) FROM (SELECT symbol FROM c1, d WHERE ts > now - INTERVAL 90 DAY GROUP BY symbol HAVING avg(ret) < 0)) AS newly_unreliable,
        (SELECT CASE WHEN first(regime ORDER BY ts, symbol) <> last(regime ORDER BY ts, symbol) THEN 1 ELSE 0 END FROM c1, d WHERE ts > now - INTERVAL 90 DAY) AS regime_flipped,
        (SELECT count(*) FROM (SELECT symbol FROM c1 GROUP BY symbol HAVING min(ts) > DATE '1998-06-01')) AS new_symbols,
        (SELECT avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) FILTER (ts > now - INTERVAL 90 DAY) - avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) FILTER (ts > now - INTERVAL 30 DAY) FROM c1, d) AS accuracy_drop, NULL AS tier_drag FROM d)"""
_TRIG = {"stale": ("days_since", "> 30"), "ic_floor": ("ic_20d", "< 0.005"), "unreliable_features": ("newly_unreliable", ">= 3"), "regime_flip": ("regime_flipped", "> 0"), "new_symbols": ("new_symbols", ">= 100"), "accuracy_drop": ("accuracy_drop", "> 0.02"), "tier_drag": ("tier_drag", "> 0.03")}


@query(
    "retrain_triggers",
    f"""WITH {_CHECKS}, l AS ({" UNION ALL ".join(f"SELECT '{n}' AS trigger, CAST({c} AS DOUBLE) AS value, coalesce({c} {r}, false) AS fired FROM ck" for n, (c, r) in _TRIG.items())})
    SELECT trigger, {s_round("value")} AS value, fired, CAST((SELECT count(*) FROM l WHERE fired) AS INT) AS triggers, (SELECT count(*) FROM l WHERE fired) >= 3 AS retrain FROM l""",
)
def _(spark, sf):
    rows = _calls(spark, sf)
    now = rows.agg(F.max("ts").alias("now")).withColumn("_one", F.lit(1))
    # One row, joined by a constant.
    rows = rows.withColumn("_one", F.lit(1)).join(now, "_one")
    near = lambda days: F.col("ts") > F.date_sub("now", days)
    hit = lambda days: F.avg(F.when(near(days), (F.col("ret") > 0).cast("double")))
    order = F.struct("ts", "symbol")
    flipped = F.min_by("regime", F.when(near(90), order)) != F.max_by("regime", F.when(near(90), order))
    by_name = rows.groupBy("symbol").agg((F.avg(F.when(near(90), F.col("ret"))) < 0).alias("bad"), (F.min("ts") > F.lit("1998-06-01").cast("date")).alias("new"))
    counts = by_name.agg(F.count_if("bad").alias("newly_unreliable"), F.count_if("new").alias("new_symbols")).withColumn("_one", F.lit(1))
    whole = rows.groupBy("_one").agg(
        F.datediff(F.max("now"), F.lit("1998-06-01").cast("date")).alias("days_since"), ops.correlation(F.when(near(20), F.col("from_mean")), F.when(near(20), F.col("ret"))).alias("ic_20d"),
        flipped.cast("int").alias("regime_flipped"), (hit(90) - hit(30)).alias("accuracy_drop"),
    )
    checks = whole.join(counts, "_one").withColumn("tier_drag", F.lit(None).cast("double"))
    return _out(ops.retrain_triggers(checks), "value", keys=("trigger", "fired", "triggers", "retrain"))


_COREW = lambda side: " + ".join(f"CASE WHEN {c}_dir = {side} THEN {ops.GROUPS[c]} * coalesce({c}_str, 0) ELSE 0 END" for c in ("ml", "feature_ic", "regime"))
_DOM = lambda a, b: f"CASE WHEN {a} > 1.15 * {b} THEN 1 WHEN {b} > 1.15 * {a} THEN -1 ELSE 0 END"
_ALIGN = f"""{_VOTE}, i1 AS (SELECT *, {_COREW(1)} AS ca, {_COREW(-1)} AS cb FROM vote), i2 AS (SELECT *, {_DOM("ca", "cb")} AS core FROM i1),
    i3 AS (SELECT *, CASE WHEN core <> 0 AND coalesce(pattern_dir = core OR probability_dir = core, false) THEN core ELSE 0 END AS mom FROM i2),
    i4 AS (SELECT *, {_DOM("(ca + CASE WHEN mom = 1 THEN 0.2 ELSE 0 END)", "(cb + CASE WHEN mom = -1 THEN 0.2 ELSE 0 END)")} AS gd FROM i3),
    i5 AS (SELECT *, CASE WHEN gd = 0 THEN 0 ELSE {" + ".join(f"CASE WHEN {c} = gd THEN 1 ELSE 0 END" for c in ("ml_dir", "feature_ic_dir", "regime_dir", "mom"))} END AS ga,
                  1 + {" + ".join(f"CASE WHEN {c}_dir IS NOT NULL THEN 1 ELSE 0 END" for c in ("ml", "feature_ic", "regime"))} AS gn FROM i4),
    al AS (SELECT *, CASE WHEN gd = 0 THEN 'NEUTRAL' WHEN ga / gn >= 0.9 THEN 'VERY_HIGH' WHEN ga / gn >= 0.65 THEN 'HIGH' WHEN ga / gn >= 0.4 THEN 'MODERATE' ELSE 'LOW' END AS level FROM i5)"""


@query("alignment_variants", f"WITH {PATTERNS}, {_ALIGN} SELECT symbol, ts, core AS core_direction, gd AS group_direction, ga AS groups_aligned, level AS group_level FROM al")
def _(spark, sf):
    return ops.independent_alignment(_voted(spark, sf)).select("symbol", "ts", "core_direction", "group_direction", "groups_aligned", "group_level")


@query(
    "component_comparison",
    f"""WITH {PATTERNS}, {_VOTE}, l AS ({" UNION ALL ".join(f"SELECT '{c}' AS component, {c}_dir AS side, {c}_dir * {c}_str AS signed, later FROM vote WHERE later IS NOT NULL AND {c}_dir <> 0" for c in _PARTS)})
    SELECT component, count(*) AS n, {s_round("avg(CASE WHEN side * later > 0 THEN 1.0 ELSE 0.0 END)")} AS hit_rate, {s_round("avg(side * later)")} AS expectancy, {s_round("CASE WHEN stddev_pop(signed) > 1e-12 THEN corr(signed, later) END")} AS ic,
           {s_round("avg(side * later) / nullif(stddev_samp(side * later), 0) * sqrt(252 / 5.0)", 5)} AS sharpe FROM l GROUP BY component""",
)
def _(spark, sf):
    out = ops.component_comparison(_voted(spark, sf), _PARTS, "later")
    return out.select("component", "n", *[rounded(F.col(c)).alias(c) for c in ("hit_rate", "expectancy", "ic")], rounded(F.col("sharpe"), 5).alias("sharpe"))


@query(
    "evidence_breakdown",
    f"""WITH {PATTERNS}, {_ALIGN}, t AS (SELECT * FROM al WHERE level IN ('HIGH', 'VERY_HIGH') AND later IS NOT NULL),
    l AS (SELECT 'aligned' AS key, CAST(aligned AS VARCHAR) AS value, later FROM t UNION ALL SELECT 'regime_supports', CASE WHEN regime_dir = gd THEN 'yes' ELSE 'no' END, later FROM t)
    SELECT key, value, count(*) AS n, {s_round("avg(CASE WHEN later > 0 THEN 1.0 ELSE 0.0 END)")} AS hit_rate, {s_round("avg(later)")} AS mean FROM l GROUP BY key, value""",
)
def _(spark, sf):
    # Written: the levels are then columns of a scan, and not expanded again for every key.
    rows = written(ops.independent_alignment(_voted(spark, sf)), "levels")
    keys = {"aligned": F.col("aligned"), "regime_supports": F.when(F.col("regime_dir") == F.col("group_direction"), "yes").otherwise("no")}
    return _out(ops.evidence_breakdown(rows, F.col("group_level").isin("HIGH", "VERY_HIGH"), keys, "later"), "hit_rate", "mean", keys=("key", "value", "n"))


@query(
    "followups",
    f"""WITH {BARS}, {MARKET}, vx AS (SELECT ts, stddev_samp(r) OVER (ORDER BY ts ROWS 19 PRECEDING) AS v FROM (SELECT ts, ln(b / lag(b) OVER (ORDER BY ts)) AS r FROM market)), md AS (SELECT median(v) AS m FROM vx),
    f AS (SELECT bars.*, close < {s_lag("close")} AS fell, ({s_lead("close", 5)} / close - 1) * 100 AS fwd, avg(close) OVER {s_frame(200)} AS s200, count(*) OVER {s_frame(200)} AS k FROM bars),
    m AS (SELECT f.symbol, fwd, coalesce(sum(CASE WHEN fell THEN 1 ELSE 0 END) OVER (PARTITION BY f.symbol ORDER BY f.ts ROWS 2 PRECEDING) = 3, false) AS base, k >= 100 AND close > s200 AS up, k >= 100 AND close < s200 AS down, coalesce(v > 0.02, false) AS wild FROM f LEFT JOIN vx USING (ts)),
    l AS (SELECT symbol, 'none' AS modifier, fwd FROM m WHERE base UNION ALL SELECT symbol, 'above_200dma', fwd FROM m WHERE base AND up UNION ALL SELECT symbol, 'below_200dma', fwd FROM m WHERE base AND down UNION ALL SELECT symbol, 'index_wild', fwd FROM m WHERE base AND wild)
    SELECT symbol, modifier, count(*) AS n, {s_round("avg(CASE WHEN fwd > 0 THEN 1.0 WHEN fwd IS NOT NULL THEN 0.0 END)")} AS hit_rate, {s_round("avg(fwd)")} AS mean, CASE WHEN count(*) < 5 THEN 'insufficient' WHEN count(*) < 30 THEN 'candidate' ELSE 'sufficient' END AS status FROM l GROUP BY symbol, modifier""",
)
def _(spark, sf):
    bars = _bars(spark, sf)
    market = features.market_bar(bars).withColumn("r", F.log(F.col("close") / lag("close")))
    wild = market.select("ts", F.stddev_samp("r").over(frame(20)).alias("v"))
    rows = outcomes.forward_returns(conditions.evaluate(bars, "consecutive_down", n=3), [5])
    rows = rows.withColumns({"s200": F.avg("close").over(frame(200)), "k": F.count(F.lit(1)).over(frame(200))}).join(wild, "ts", "left")
    ready = F.col("k") >= 100
    modifiers = {"above_200dma": ready & (F.col("close") > F.col("s200")), "below_200dma": ready & (F.col("close") < F.col("s200")), "index_wild": F.col("v") > 0.02}
    return _out(ops.followups(rows, "signal", modifiers, "fwd_5d"), "hit_rate", "mean", keys=("symbol", "modifier", "n", "status"))


_SECT = f"""{BARS}, {MARKET}, r AS (SELECT symbol, ts, close / {s_lag("close", 20)} - 1 AS r20 FROM bars), mb AS (SELECT ts, b / lag(b, 20) OVER (ORDER BY ts) - 1 AS b20 FROM market),
    rs AS (SELECT symbol, ts, r20 - b20 AS rs FROM r JOIN mb USING (ts)), rk AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY coalesce(rs, -999) DESC, symbol) AS k FROM rs)"""


def _sectors(spark, sf):
    bars = _bars(spark, sf)
    return features.sector_strength(bars, features.market_bar(bars))


@query(
    "sector_leading_nd",
    f"""WITH {_SECT}, s AS (SELECT ts, k FROM rk WHERE symbol = '2-HIGH'), j AS (SELECT bars.symbol, bars.ts, CASE WHEN coalesce(s.k, 99) <= 2 THEN 1 ELSE 0 END AS ok FROM bars LEFT JOIN s USING (ts))
    SELECT symbol, ts, sum(ok) OVER {s_frame(5)} = 5 AS signal FROM j""",
)
def _(spark, sf):
    return conditions.sector_leading(_bars(spark, sf), _sectors(spark, sf), "2-HIGH", 2, 5).select("symbol", "ts", "signal")


@query("pair_strength", f"WITH {_SECT} SELECT a.ts, coalesce(a.rs > b.rs, false) AS signal FROM rs a JOIN rs b USING (ts) WHERE a.symbol = '1-URGENT' AND b.symbol = '5-LOW'")
def _(spark, sf):
    return conditions.pair_strength(_sectors(spark, sf), "1-URGENT", "5-LOW")
