"""Queries over the feature matrix: proxies, components, the weighted vote, scores, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import by_symbol, rounded
from ..operators import features, matrix, patterns, votes
from ..sources import matrix as files
from ..sources.written import new_folder, written
from .features import _bars, _out
from .patterns import PATTERNS
from .registry import BARS, HOURLY, W, query, s_full, s_lag, s_round

_RETURNS = ", ".join(f"CASE WHEN {s_lag('close', n)} > 0 AND close > 0 THEN ln(close / {s_lag('close', n)}) END AS return_{n}d" for n in features.RETURNS)
_AVERAGES = ", ".join(f"{s_full(n, 'avg(close)')} AS a{n}" for n in features.AVERAGES)
_SIDES = ", ".join(f"close / a{n} - 1 AS sma_distance_{n}, CAST(close > a{n} AS DOUBLE) AS above_sma_{n}" for n in features.AVERAGES)
_LAST = lambda n: f"(PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"
#: Rows of the matrix, after ``bars``.
MX = f"""
    mk AS (SELECT ts, avg(close) AS c FROM bars GROUP BY ts),
    mk1 AS (
        SELECT ts, c > CASE WHEN count(*) OVER (ORDER BY ts ROWS 49 PRECEDING) = 50 THEN avg(c) OVER (ORDER BY ts ROWS 49 PRECEDING) END AS x50,
               c > CASE WHEN count(*) OVER (ORDER BY ts ROWS 199 PRECEDING) = 200 THEN avg(c) OVER (ORDER BY ts ROWS 199 PRECEDING) END AS x200
        FROM mk),
    mk2 AS (SELECT ts, CAST(CASE WHEN x50 AND x200 THEN 1 WHEN NOT x50 AND NOT x200 THEN -1 ELSE 0 END AS DOUBLE) AS market_trend, CAST(x200 AS DOUBLE) AS market_above_200 FROM mk1),
    mx1 AS (SELECT *, close - {s_lag("close")} AS d, {s_lag("close")} AS p, {_RETURNS}, {_AVERAGES}, {s_full(20, "avg(volume)", -1)} AS v20 FROM bars),
    mx2 AS (
        SELECT *, CASE WHEN p IS NOT NULL THEN greatest(high - low, abs(high - p), abs(low - p)) END AS tr, count(d) OVER {_LAST(14)} AS nd,
               avg(greatest(d, 0)) OVER {_LAST(14)} AS g, avg(greatest(-d, 0)) OVER {_LAST(14)} AS l
        FROM mx1),
    mx AS (
        SELECT symbol, ts, open, high, low, close, volume, {", ".join(f"return_{n}d" for n in features.RETURNS)},
               CASE WHEN nd = 14 THEN CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END END AS rsi_14,
               {", ".join(f"CASE WHEN count(return_1d) OVER {_LAST(n)} = {n} THEN stddev_samp(return_1d) OVER {_LAST(n)} * sqrt(252.0) END AS realized_vol_{n}" for n in (20, 60))},
               CASE WHEN count(tr) OVER {_LAST(14)} = 14 THEN avg(tr) OVER {_LAST(14)} END / close AS atr_pct,
               {s_full(20, "avg(close * volume)")} AS dollar_volume_20, volume / v20 AS volume_ratio_20,
               close / ({s_full(252, "min(low)")}) - 1 AS dist_52w_low, 1 - close / ({s_full(252, "max(high)")}) AS dist_52w_high, {_SIDES}, market_trend, market_above_200,
               lead(close, 5) OVER ({W}) / close - 1 AS later, row_number() OVER ({W}) AS k
        FROM mx2 LEFT JOIN mk2 USING (ts))"""
_TRIGGERS = {
    "consecutive_down": "return_3d < 0", "consecutive_up": "return_3d > 0", "oversold_rsi": "rsi_14 <= 30", "overbought_rsi": "rsi_14 >= 70", "gap_down": "return_1d <= -0.02",
    "near_52w_low": "dist_52w_low <= 0.05", "near_52w_high": "dist_52w_high <= 0.05", "high_volume": "volume_ratio_20 >= 2.0",
}
_MT = f"""{MX}, mt AS (SELECT *, {", ".join(f"coalesce({r}, false) AS {n}" for n, r in _TRIGGERS.items())} FROM mx)"""


def _later():
    return F.lead("close", 5).over(by_symbol()) / F.col("close") - 1


def _matrix(spark, sf, bars=None):
    return matrix.feature_matrix(_bars(spark, sf) if bars is None else bars).withColumns({"later": _later(), "k": F.row_number().over(by_symbol())})


def _triggered(spark, sf, bars=None):
    return _matrix(spark, sf, bars).withColumns(matrix.trigger_proxies())


@query("feature_matrix", f"WITH {BARS}, {MX} SELECT symbol, ts, {', '.join(f'{s_round(c)} AS {c}' for c in matrix.NAMES)} FROM mx")
def _(spark, sf):
    return _out(_matrix(spark, sf), *matrix.NAMES)


@query("trigger_proxies", f"WITH {BARS}, {_MT} SELECT symbol, ts, {', '.join(_TRIGGERS)} FROM mt")
def _(spark, sf):
    return _triggered(spark, sf).select("symbol", "ts", *_TRIGGERS)


@query(
    "feature_matrix_files",
    f"""WITH {BARS}, {MX} SELECT symbol, ts AS date, {s_round("rsi_14")} AS rsi_14, {s_round("return_20d")} AS return_20d, CAST(NULL AS DOUBLE) AS not_there, {s_round("later")} AS later
    FROM mx WHERE ts BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND later IS NOT NULL AND least(1.0, k / 500.0) >= 0.7""",
)
def _(spark, sf):
    path = new_folder(spark, "matrix")
    rows = _matrix(spark, sf).withColumn("data_quality_score", F.least(F.lit(1.0), F.col("k") / 500))
    files.write_feature_matrix(rows, path)
    out = files.read_feature_matrix(spark, path, "1996-01-01", "1997-12-31", ["rsi_14", "return_20d", "not_there"], "later", 0.7)
    return _out(out, "rsi_14", "return_20d", "not_there", "later", keys=("symbol", "date"))


#: What validated patterns and signals did in all bars; their columns are joined back to each row.
_PS = " UNION ALL ".join(f"SELECT '{n}' AS pattern, later FROM mt WHERE {n} AND later IS NOT NULL" for n in _TRIGGERS)
_PATTERN = f"""{_MT},
    ps AS (SELECT pattern, count(*) AS n, avg(CASE WHEN later > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate, avg(later) AS avg_return FROM ({_PS}) GROUP BY pattern HAVING count(*) >= 20),
    fired AS ({" UNION ALL ".join(f"SELECT symbol, ts, '{n}' AS pattern FROM mt WHERE {n}" for n in _TRIGGERS)}),
    pa AS (
        SELECT symbol, ts, count(*) AS active, count(*) FILTER (hit_rate >= 0.5 AND avg_return > 0) AS up, count(*) FILTER (hit_rate >= 0.5 AND avg_return < 0) AS down,
               coalesce(avg(hit_rate) FILTER (hit_rate >= 0.5 AND avg_return <> 0), 0.5) AS rate
        FROM fired JOIN ps USING (pattern) GROUP BY symbol, ts),
    pattern AS (
        SELECT symbol, ts, CAST(sign(up - down) AS INT) AS pattern_dir,
               CASE WHEN up <> down THEN greatest(least(greatest(up, down) / active * (rate - 0.5) * 4.0, 1.0), 0.0) ELSE 0.0 END AS pattern_str
        FROM pa)"""


def _with_pattern(rows):
    return votes.component_pattern(rows, list(_TRIGGERS), matrix.trigger_stats(rows, list(_TRIGGERS), "later"), hit=0.5)


@query("component_pattern", f"WITH {BARS}, {_PATTERN} SELECT mt.symbol, mt.ts, pattern_dir, {s_round('pattern_str')} AS pattern_str FROM mt LEFT JOIN pattern USING (symbol, ts)")
def _(spark, sf):
    return _out(_with_pattern(_triggered(spark, sf)), "pattern_str", keys=("symbol", "ts", "pattern_dir"))


#: Candlestick patterns stand for the calibrated signals.
_SIGNALS = """
    cal AS (SELECT pattern AS signal, count(later) AS n, avg(CASE WHEN later > 0 THEN 1.0 WHEN later IS NOT NULL THEN 0.0 END) AS hit_rate, avg(later) AS avg_return
            FROM sig JOIN mt USING (symbol, ts) GROUP BY pattern),
    pr AS (SELECT symbol, ts, sum(CASE WHEN avg_return > 0 THEN abs((hit_rate - 0.5) * least(1.0, n / 200.0)) ELSE 0 END) AS up,
                  sum(CASE WHEN avg_return > 0 THEN 0 ELSE abs((hit_rate - 0.5) * least(1.0, n / 200.0)) END) AS down, count(*) AS n
           FROM sig JOIN cal ON sig.pattern = cal.signal WHERE cal.n >= 30 AND hit_rate >= 0.48 GROUP BY symbol, ts),
    probability AS (SELECT symbol, ts, CASE WHEN up / (up + down) >= 0.6 THEN 1 WHEN 1 - up / (up + down) >= 0.6 THEN -1 ELSE 0 END AS probability_dir, abs(2 * (up / (up + down)) - 1) AS probability_str
                    FROM pr WHERE n >= 2 AND up + down > 0)"""


def _with_probability(bars, rows, known=None):
    """``known`` has ``symbol, ts, later`` of all rows; by default they are taken from ``rows``."""
    fired = patterns.pattern_signals(bars).select("symbol", "ts", F.col("pattern").alias("signal"))
    later = (rows if known is None else known).select("symbol", "ts", "later").where("later is not null")
    known = fired.join(later, ["symbol", "ts"])
    hit = F.avg((F.col("later") > 0).cast("double"))
    promoted = known.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), hit.alias("hit_rate"), F.avg("later").alias("avg_return"))
    return votes.component_probability(rows, fired, promoted, hit=0.48)


@query("component_probability", f"WITH {PATTERNS}, {_MT}, {_SIGNALS} SELECT mt.symbol, mt.ts, probability_dir, {s_round('probability_str')} AS probability_str FROM mt LEFT JOIN probability USING (symbol, ts)")
def _(spark, sf):
    bars = _bars(spark, sf)
    return _out(_with_probability(bars, _triggered(spark, sf, bars)), "probability_str", keys=("symbol", "ts", "probability_dir"))


#: Features whose correlation with the later return is measured in each market regime.
_FEATURES = ("return_1d", "return_5d", "return_20d", "rsi_c", "sma_distance_20", "sma_distance_50", "sma_distance_200", "volume_c")
_REGIME = "CASE WHEN market_trend > 0 THEN 'bull' WHEN market_trend < 0 THEN 'bear' WHEN market_trend = 0 THEN 'range' WHEN market_above_200 > 0.5 THEN 'bull' WHEN market_above_200 <= 0.5 THEN 'bear' END"
_IC = f"""
    mr AS (SELECT *, {_REGIME} AS regime, rsi_14 - 50 AS rsi_c, volume_ratio_20 - 1 AS volume_c FROM mt),
    ic AS (SELECT regime, feature, corr(value, later) AS ic FROM (UNPIVOT (SELECT regime, later, {", ".join(_FEATURES)} FROM mr WHERE later IS NOT NULL) ON {", ".join(_FEATURES)} INTO NAME feature VALUE value)
           WHERE value IS NOT NULL GROUP BY regime, feature),
    lf AS (UNPIVOT (SELECT symbol, ts, regime, {", ".join(_FEATURES)} FROM mr) ON {", ".join(_FEATURES)} INTO NAME feature VALUE value),
    fi AS (SELECT symbol, ts, sum(CASE WHEN (ic > 0) = (value > 0) THEN abs(ic) * 0.5 ELSE 0 END) AS up, sum(CASE WHEN (ic > 0) = (value > 0) THEN 0 ELSE abs(ic) * 0.5 END) AS down, count(*) AS n
           FROM lf JOIN ic USING (regime, feature) WHERE abs(ic) >= 0.008 AND value IS NOT NULL GROUP BY symbol, ts),
    feature_ic AS (SELECT symbol, ts, CASE WHEN up / (up + down) >= 0.6 THEN 1 WHEN 1 - up / (up + down) >= 0.6 THEN -1 ELSE 0 END AS feature_ic_dir, abs(2 * (up / (up + down)) - 1) AS feature_ic_str
                   FROM fi WHERE n >= 5 AND up + down > 0)"""


def _with_feature_ic(rows):
    regime, _, _ = votes.component_regime(F.col("market_trend"), F.col("market_above_200"))
    rows = rows.withColumns({"regime": regime, "rsi_c": F.col("rsi_14") - 50, "volume_c": F.col("volume_ratio_20") - 1})
    long = rows.where("later is not null").unpivot(["regime", "later"], list(_FEATURES), "feature", "value").where("value is not null")
    ics = long.groupBy("regime", "feature").agg(F.corr("value", "later").alias("mean_ic")).withColumn("sign_stability", F.lit(None).cast("double"))
    return votes.component_feature_ic(rows, list(_FEATURES), ics)


@query("component_feature_ic", f"WITH {BARS}, {_MT}, {_IC} SELECT mt.symbol, mt.ts, feature_ic_dir, {s_round('feature_ic_str')} AS feature_ic_str FROM mt LEFT JOIN feature_ic USING (symbol, ts)")
def _(spark, sf):
    return _out(_with_feature_ic(_triggered(spark, sf)), "feature_ic_str", keys=("symbol", "ts", "feature_ic_dir"))


#: A model's output for the vote: a logistic of three features, and its rank on the date.
_ML = """
    pd AS (SELECT *, 1 / (1 + exp(-round(12 * coalesce(sma_distance_50, 0) - 8 * coalesce(return_5d, 0) + coalesce(rsi_c, 0) / 50, 6))) AS probability FROM mr),
    ml AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY ts) > 1 THEN (rank() OVER (PARTITION BY ts ORDER BY probability) - 1) / (count(*) OVER (PARTITION BY ts) - 1.0) ELSE 0 END AS rk FROM pd)"""
_PARTS = ("ml", "pattern", "probability", "feature_ic", "regime")
_SUM = lambda side: " + ".join(f"CASE WHEN {c}_dir = {side} THEN {votes.WEIGHTS[c]} * {c}_str ELSE 0 END" for c in _PARTS)
_COUNT = lambda side: " + ".join(f"CASE WHEN {c}_dir = {side} THEN 1 ELSE 0 END" for c in _PARTS)
_AGREE = lambda value: " + ".join(f"CASE WHEN {c}_dir = direction THEN {value(c)} ELSE 0 END" for c in _PARTS if c != "regime")
_VOTE = f"""{_PATTERN}, {_SIGNALS}, {_IC}, {_ML},
    pt AS (
        SELECT ml.symbol, ml.ts, regime, later, CASE WHEN probability >= 0.55 THEN 1 WHEN probability <= 0.45 THEN -1 ELSE 0 END AS ml_dir,
               CASE WHEN probability >= 0.55 OR probability <= 0.45 THEN 0.6 * abs(probability - 0.5) * 2 + 0.4 * abs(rk - 0.5) * 2 ELSE 0 END AS ml_str,
               pattern_dir, pattern_str, probability_dir, probability_str, feature_ic_dir, feature_ic_str,
               CASE WHEN regime IS NULL THEN NULL WHEN regime = 'bull' AND coalesce(market_above_200 > 0.5, false) THEN 1 WHEN regime = 'bear' AND NOT coalesce(market_above_200 > 0.5, false) THEN -1 ELSE 0 END AS regime_dir,
               least(CASE WHEN k < 100 THEN 10 WHEN k < 300 THEN 4 ELSE 0 END + CASE WHEN dollar_volume_20 * 20 < 1000000 THEN 10 WHEN dollar_volume_20 * 20 < 5000000 THEN 4 ELSE 0 END
                     + CASE WHEN -dist_52w_high / 10 < -0.05 THEN 5 WHEN -dist_52w_high / 10 < -0.02 THEN 2 ELSE 0 END + CASE WHEN atr_pct > 0.06 THEN 3 ELSE 0 END, 25) AS risk
        FROM ml LEFT JOIN pattern USING (symbol, ts) LEFT JOIN probability USING (symbol, ts) LEFT JOIN feature_ic USING (symbol, ts)),
    v1 AS (SELECT *, CASE WHEN regime_dir <> 0 THEN 0.7 WHEN regime_dir = 0 THEN 0.3 END AS regime_str FROM pt),
    v2 AS (SELECT *, {_SUM(1)} AS bull, {_SUM(-1)} AS bear, {_COUNT(1)} AS up, {_COUNT(-1)} AS down, {_COUNT(0)} AS flat FROM v1),
    v3 AS (SELECT *, CASE WHEN bull > 1.15 * bear THEN 1 WHEN bear > 1.15 * bull THEN -1 ELSE 0 END AS direction FROM v2),
    v4 AS (SELECT *, CASE direction WHEN 1 THEN up WHEN -1 THEN down ELSE greatest(up, down) END AS aligned, CASE direction WHEN 1 THEN down WHEN -1 THEN up ELSE least(up, down) END AS conflicting,
                  {_AGREE(lambda c: votes.WEIGHTS[c])} AS w, {_AGREE(lambda c: f"{votes.WEIGHTS[c]} * {c}_str")} AS s,
                  CASE WHEN regime IS NULL THEN 0.9 {" ".join(f"WHEN regime = '{r}' AND direction = {d} THEN {v}" for (r, d), v in votes.FITNESS.items())} ELSE 0.85 END AS fit FROM v3),
    vote AS (SELECT *, least(greatest(CASE WHEN direction = 0 THEN 20 + greatest(0, 20 - 4 * conflicting) WHEN w = 0 THEN 20
                  ELSE (0.65 * s / w + 0.35 * aligned / (up + down + flat)) * 100 * fit END - risk, 0), 100) AS score FROM v4)"""


def _components(spark, sf):
    """The matrix with direction and strength of every component, written once for all queries over the vote.

    The matrix is written first: trigger statistics, correlations and the rows
    themselves read it. Each component's columns are then plain columns of a scan,
    however often the vote uses them.
    """
    bars = _bars(spark, sf)
    base = written(_triggered(spark, sf, bars), "matrix")
    rows = _with_probability(bars, _with_feature_ic(_with_pattern(base)), base)
    known = lambda c: F.coalesce(c, F.lit(0.0))
    logit = F.round(12 * known("sma_distance_50") - 8 * known("return_5d") + known("rsi_c") / 50, 6)
    rows = rows.withColumn("probability", 1 / (1 + F.exp(-logit)))
    rows = rows.withColumn("rk", F.percent_rank().over(Window.partitionBy("ts").orderBy("probability")))
    ml, strength = votes.component_ml(F.col("probability"), F.col("rk"))
    _, regime, regime_strength = votes.component_regime(F.col("market_trend"), F.col("market_above_200"))
    quality = F.when(F.col("k") < 100, 0.65).when(F.col("k") < 300, 0.75).otherwise(0.9)
    risk = votes.component_risk(quality, F.col("dollar_volume_20") * 20, -F.col("dist_52w_high") / 10, F.col("atr_pct"))
    rows = rows.withColumns({"ml_dir": ml, "ml_str": strength, "regime_dir": regime, "regime_str": regime_strength, "risk": risk})
    return written(rows, "components")


def _voted(spark, sf):
    return votes.confluence_score(votes.alignment(_components(spark, sf), list(_PARTS)), list(_PARTS))


@query("run_confluence", f"WITH {PATTERNS}, {_VOTE} SELECT symbol, ts, direction, aligned, conflicting, flat AS neutral, {s_round('risk')} AS risk, {s_round('score', 4)} AS score FROM vote")
def _(spark, sf):
    out = _voted(spark, sf)
    return out.select("symbol", "ts", "direction", "aligned", "conflicting", "neutral", rounded(F.col("risk")).alias("risk"), rounded(F.col("score"), 4).alias("score"))


_TIER = "CASE symbol WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 ELSE 9 END"
_B20 = lambda c: f"CASE WHEN {c} < 20 THEN '0-20' WHEN {c} < 40 THEN '20-40' WHEN {c} < 60 THEN '40-60' WHEN {c} < 80 THEN '60-80' WHEN {c} IS NOT NULL THEN '80-100' END"
_SCORES = f"""{MX},
    s1 AS (SELECT *, {_TIER} AS tier, least(coalesce(above_sma_20, 0) * 15 + coalesce(above_sma_50, 0) * 20 + coalesce(above_sma_200, 0) * 25 + least(greatest(coalesce(rsi_14, 50) / 100 * 40, 0), 40), 100) AS v1,
        coalesce(rsi_14, 50) AS r, coalesce(volume_ratio_20, 1) AS vr FROM mx),
    s2 AS (SELECT *, least(greatest(CASE WHEN r < 30 THEN 40 WHEN r < 40 THEN 30 WHEN r < 50 THEN 20 WHEN r < 60 THEN 10 WHEN r < 70 THEN 5 ELSE 0 END
        + (1 - least(greatest(coalesce(realized_vol_20, 25), 0), 80) / 80) * 30 + CASE WHEN coalesce(above_sma_200, 0) = 0 THEN 20 WHEN coalesce(sma_distance_200, 0) < 0.05 THEN 10 ELSE 0 END
        - CASE WHEN vr > 3 THEN 20 WHEN vr > 2 THEN 10 ELSE 0 END, 0), 90) AS v2 FROM s1),
    sc AS (SELECT symbol, ts, later, v1, v2, 0.4 * v1 + 0.6 * v2 AS v3, CASE tier WHEN 1 THEN 0.2 * v1 + 0.8 * v2 WHEN 2 THEN 0.3 * v1 + 0.7 * v2 WHEN 3 THEN 0.5 * v1 + 0.5 * v2 WHEN 4 THEN 0.65 * v1 + 0.35 * v2 ELSE 0.4 * v1 + 0.6 * v2 END AS v4 FROM s2)"""


def _scored(spark, sf):
    tier = F.when(F.col("symbol") == "1-URGENT", 1).when(F.col("symbol") == "2-HIGH", 2).when(F.col("symbol") == "3-MEDIUM", 3).when(F.col("symbol") == "4-NOT SPECIFIED", 4).otherwise(9)
    return matrix.score_variants(_matrix(spark, sf), tier)


@query(
    "score_variants",
    f"WITH {BARS}, {_SCORES} SELECT symbol, ts, {', '.join(f'{s_round(f"v{i}", 4)} AS score_{n}, {_B20(f"round(v{i}, 9)")} AS bucket_{n}' for i, n in enumerate(matrix.VARIANTS, 1))} FROM sc",
)
def _(spark, sf):
    out = _scored(spark, sf)
    buckets = [matrix.bucket_20(F.round(f"score_{n}", 9)).alias(f"bucket_{n}") for n in matrix.VARIANTS]
    return out.select("symbol", "ts", *[rounded(F.col(f"score_{n}"), 4).alias(f"score_{n}") for n in matrix.VARIANTS], *buckets)


_LONG_SCORES = " UNION ALL ".join(f"SELECT '{n}' AS variant, {_B20(f'round(v{i}, 9)')} AS bucket, later FROM sc WHERE later IS NOT NULL" for i, n in enumerate(matrix.VARIANTS, 1))


@query(
    "score_backtest",
    f"""WITH {BARS}, {_SCORES}, l AS ({_LONG_SCORES}), b AS (SELECT variant, avg(CASE WHEN later > 0 THEN 1.0 ELSE 0.0 END) AS base FROM l GROUP BY variant)
    SELECT variant, bucket, count(*) AS n, {s_round("avg(CASE WHEN later > 0 THEN 1.0 ELSE 0.0 END)")} AS hit_rate, {s_round("avg(later)")} AS avg_return,
           {s_round("avg(CASE WHEN later > 0 THEN 1.0 ELSE 0.0 END) - min(base)")} AS edge FROM l JOIN b USING (variant) GROUP BY variant, bucket""",
)
def _(spark, sf):
    rows = _scored(spark, sf).where("later is not null")
    pairs = F.array(*[F.struct(F.lit(n).alias("variant"), matrix.bucket_20(F.round(f"score_{n}", 9)).alias("bucket")) for n in matrix.VARIANTS])
    long = rows.select("later", F.inline(pairs))
    hit = F.avg((F.col("later") > 0).cast("double"))
    base = long.groupBy("variant").agg(hit.alias("base"))
    out = long.groupBy("variant", "bucket").agg(F.count(F.lit(1)).alias("n"), hit.alias("hit_rate"), F.avg("later").alias("avg_return")).join(base, "variant")
    return _out(out.withColumn("edge", F.col("hit_rate") - F.col("base")), "hit_rate", "avg_return", "edge", keys=("variant", "bucket", "n"))


_BREAK = ("marubozu_bull", "long_bull", "three_white_soldiers")
_PULL = "CASE WHEN return_20d > 0 AND return_5d < 0 THEN 'pullback' WHEN return_20d < 0 AND return_5d < 0 THEN 'reversal' END"
_COMPS = f"""{MX}, pl AS (SELECT symbol, ts, list(pattern ORDER BY pattern) AS pats FROM sig GROUP BY symbol, ts),
    c1 AS (SELECT mx.*, coalesce(pats, []) AS pats, {_PULL} AS pull, CASE WHEN dist_52w_high IS NOT NULL THEN 100 * (1 - least(dist_52w_high, 1)) END AS rs FROM mx LEFT JOIN pl USING (symbol, ts)),
    c2 AS (SELECT *, len(pats) AS np, len(list_intersect(pats, {list(_BREAK)})) AS nb, CASE pull WHEN 'pullback' THEN 70.0 WHEN 'reversal' THEN 20.0 ELSE 45.0 END AS base FROM c1),
    c3 AS (SELECT *, CASE WHEN atr_pct IS NOT NULL THEN round((1 - greatest(0, least(atr_pct * 100, 15)) / 15) * 100, 1) END AS volatility_component,
        CASE np WHEN 0 THEN 0 WHEN 1 THEN 30 WHEN 2 THEN 55 WHEN 3 THEN 70 ELSE least(85 + (np - 4) * 5, 100) END AS pattern_component, CASE nb WHEN 0 THEN 0 WHEN 1 THEN 60 ELSE 100 END AS breakout_component,
        round(coalesce(base * 0.6 + rs * 0.4, base), 1) AS support_component FROM c2),
    comp AS (SELECT *, {" + ".join(f"CASE WHEN {c} >= 70 THEN 1 ELSE 0 END" for c in ("volatility_component", "pattern_component", "breakout_component", "support_component"))} AS flags_bull,
        {" + ".join(f"CASE WHEN {c} <= 30 THEN 1 ELSE 0 END" for c in ("volatility_component", "pattern_component", "breakout_component", "support_component"))} AS flags_bear FROM c3)"""
_CNAMES = ("volatility_component", "pattern_component", "breakout_component", "support_component")


def _componentwise(spark, sf):
    bars = _bars(spark, sf)
    fired = patterns.pattern_signals(bars).groupBy("symbol", "ts").agg(F.collect_list("pattern").alias("patterns"))
    rows = _matrix(spark, sf, bars).join(fired, ["symbol", "ts"], "left").withColumn("patterns", F.coalesce("patterns", F.array().cast("array<string>")))
    pull = F.when((F.col("return_20d") > 0) & (F.col("return_5d") < 0), "pullback").when((F.col("return_20d") < 0) & (F.col("return_5d") < 0), "reversal")
    rs = F.when(F.col("dist_52w_high").isNotNull(), 100 * (1 - F.least("dist_52w_high", F.lit(1.0))))
    return matrix.component_scores(rows.withColumns({"pullback_class": pull, "rs_score": rs, "atr_pct": F.col("atr_pct") * 100}), breakouts=_BREAK)


@query("component_scores", f"WITH {PATTERNS}, {_COMPS} SELECT symbol, ts, {', '.join(f'{s_round(c, 4)} AS {c}' for c in ('pattern_component', 'breakout_component'))}, {s_round('volatility_component', 0)} AS volatility_component, flags_bull, flags_bear FROM comp")
def _(spark, sf):
    out = _componentwise(spark, sf)
    return out.select("symbol", "ts", *[rounded(F.col(c), 4).alias(c) for c in ("pattern_component", "breakout_component")], rounded(F.col("volatility_component"), 0).alias("volatility_component"), "flags_bull", "flags_bear")


_ZONES = {"pattern": "pattern_component", "breakout": "breakout_component"}


@query(
    "score_decomposition",
    f"""WITH {PATTERNS}, {_COMPS}, k AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY flags_bull - flags_bear DESC, symbol) AS rk, count(*) OVER (PARTITION BY ts) AS nn FROM comp),
    z AS (SELECT 'flags_bull' AS key, CAST(flags_bull AS VARCHAR) AS value, later FROM k UNION ALL SELECT 'flags_bear', CAST(flags_bear AS VARCHAR), later FROM k
        UNION ALL SELECT 'breakout', CASE WHEN breakout_component > 0 THEN 'yes' ELSE 'no' END, later FROM k UNION ALL SELECT 'pullback', coalesce(pull, 'ambiguous'), later FROM k
        UNION ALL SELECT 'pattern', CASE WHEN pattern_component >= 70 THEN 'high' WHEN pattern_component > 30 THEN 'mid' ELSE 'low' END, later FROM k
        UNION ALL SELECT 'rank_quartile', 'q' || CAST(1 + (rk - 1) * 4 // nn AS INT), later FROM k),
    b AS (SELECT avg(CASE WHEN later > 0 THEN 1.0 ELSE 0.0 END) AS base FROM comp WHERE later IS NOT NULL)
    SELECT key, value, count(*) AS n, {s_round("avg(CASE WHEN later > 0 THEN 1.0 ELSE 0.0 END)")} AS hit_rate, {s_round("avg(later)")} AS avg_return, {s_round("avg(CASE WHEN later > 0 THEN 1.0 ELSE 0.0 END) - min(base)")} AS edge
    FROM z, b WHERE later IS NOT NULL GROUP BY key, value""",
)
def _(spark, sf):
    day = Window.partitionBy("ts")
    rows = _componentwise(spark, sf)
    rank = F.row_number().over(day.orderBy(F.desc(F.col("flags_bull") - F.col("flags_bear")), "symbol"))
    rows = rows.withColumns({"rk": rank, "nn": F.count(F.lit(1)).over(day)}).where("later is not null")
    part = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    zone = F.when(F.col("pattern_component") >= 70, "high").when(F.col("pattern_component") > 30, "mid").otherwise("low")
    parts = [
        part("flags_bull", F.col("flags_bull")), part("flags_bear", F.col("flags_bear")), part("breakout", F.when(F.col("breakout_component") > 0, "yes").otherwise("no")),
        part("pullback", F.coalesce("pullback_class", F.lit("ambiguous"))), part("pattern", zone), part("rank_quartile", F.concat(F.lit("q"), (1 + F.floor((F.col("rk") - 1) * 4 / F.col("nn"))).cast("int"))),
    ]
    long = rows.select("later", F.inline(F.array(*parts)))
    hit = F.avg((F.col("later") > 0).cast("double"))
    out = long.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), hit.alias("hit_rate"), F.avg("later").alias("avg_return"))
    # One row, joined by a constant: the base of all.
    base = rows.groupBy(F.lit(1).alias("one")).agg(hit.alias("base"))
    out = out.withColumn("one", F.lit(1)).join(base, "one").withColumn("edge", F.col("hit_rate") - F.col("base"))
    return _out(out, "hit_rate", "avg_return", "edge", keys=("key", "value", "n"))


@query(
    "rank_bucket_calibration",
    f"""WITH {BARS}, {_SCORES}, r AS (SELECT *, (rank() OVER (PARTITION BY ts ORDER BY round(v1, 9)) - 1) / greatest(count(*) OVER (PARTITION BY ts) - 1.0, 1.0) AS p FROM sc),
    b AS (SELECT CASE WHEN p < 0.2 THEN 'bottom' WHEN p < 0.4 THEN 'low' WHEN p < 0.6 THEN 'mid' WHEN p < 0.8 THEN 'high' ELSE 'top' END AS band, later FROM r WHERE later IS NOT NULL)
    SELECT band, count(*) AS n, {s_round("avg(CASE WHEN later > 0 THEN 1.0 ELSE 0.0 END)")} AS hit_rate, {s_round("avg(later)")} AS avg_return FROM b GROUP BY band""",
)
def _(spark, sf):
    from pyspark.sql.window import Window

    p = F.percent_rank().over(Window.partitionBy("ts").orderBy(F.round("score_v1_current", 9)))
    rows = _scored(spark, sf).withColumn("p", p).where("later is not null")
    band = F.when(F.col("p") < 0.2, "bottom").when(F.col("p") < 0.4, "low").when(F.col("p") < 0.6, "mid").when(F.col("p") < 0.8, "high").otherwise("top")
    out = rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("later") > 0).cast("double")).alias("hit_rate"), F.avg("later").alias("avg_return"))
    return _out(out, "hit_rate", "avg_return", keys=("band", "n"))


_DRIVERS = ["dist_52w_low", "rsi_14", "return_20d", "volume_ratio_20", "return_1d"]
_NAMED = sorted(["rsi_14", "return_5d", "return_60d", "dist_52w_low"])


@query(
    "export_snapshot",
    f"""WITH {BARS}, {MX} SELECT symbol, ts, array_to_string(list_filter([{", ".join(f"CASE WHEN {d} IS NOT NULL THEN '{d}' END" for d in _DRIVERS)}], lambda x: x IS NOT NULL)[1:3], '|') AS top_drivers,
    {" + ".join(f"({n} IS NOT NULL)::INT" for n in _NAMED)} AS present, {" + ".join(f"({n} IS NULL)::INT" for n in _NAMED)} AS missing, {s_round("rsi_14")} AS rsi FROM mx""",
)
def _(spark, sf):
    out = matrix.export_snapshot(_matrix(spark, sf), _NAMED, _DRIVERS)
    return out.select("symbol", "ts", "top_drivers", "present", "missing", rounded(F.get_json_object("features", "$.rsi_14").cast("double")).alias("rsi"))


_PRODUCTS = [(f, m) for f in ("return_5d", "return_20d", "rsi_14", "sma_distance_50", "volume_ratio_20") for m in ("market_above_200", "market_bull")]


@query(
    "regime_interactions",
    f"WITH {BARS}, {MX}, b AS (SELECT *, CASE WHEN market_trend > 0 THEN 1.0 WHEN market_trend IS NOT NULL THEN 0.0 END AS market_bull FROM mx) SELECT symbol, ts, {', '.join(f'{s_round(f"{f} * coalesce({m}, 0)")} AS {f}_x_{m}' for f, m in _PRODUCTS)} FROM b",
)
def _(spark, sf):
    rows = _matrix(spark, sf).withColumn("market_bull", (F.col("market_trend") > 0).cast("double"))
    out = features.regime_interactions(rows, list(dict.fromkeys(f for f, _ in _PRODUCTS)), ["market_above_200", "market_bull"])
    return _out(out, *[f"{f}_x_{m}" for f, m in _PRODUCTS])


_BF = ("return_1d", "return_3d", "return_5d", "return_10d", "return_20d", "return_60d", "rsi_14", "realized_vol_20", "realized_vol_60", "dollar_volume_20", "volume_ratio_20", "sma_distance_20", "sma_distance_50",
       "sma_distance_200", "above_sma_20", "above_sma_50", "above_sma_200")
_BF2 = {"roc_10": f"close / {s_lag('close', 10)} - 1", "sma_distance_momentum_50": f"sma_distance_50 - {s_lag('sma_distance_50', 5)}", "rsi_momentum": f"rsi_14 - {s_lag('rsi_14', 5)}", "volume_trend_5": f"{s_full(5, 'avg(volume)')} / ({s_full(5, 'avg(volume)', -5)}) - 1"}
_BF3 = {f"rs_{n}": f"CASE WHEN {s_lag('close', n)} > 0 AND close > 0 THEN ln(close / {s_lag('close', n)}) END - CASE WHEN {s_lag('c', n)} > 0 AND c > 0 THEN ln(c / {s_lag('c', n)}) END" for n in (20, 60, 120)}


@query(
    "build_features",
    f"""WITH {BARS}, {MX}, bf AS (SELECT mx.*, mk.c, {", ".join(f"{x} AS {n}" for n, x in (_BF2 | _BF3).items())} FROM mx JOIN mk USING (ts)), bg AS (SELECT *, rs_20 - {s_lag("rs_20", 5)} AS rs_momentum FROM bf)
    SELECT symbol, ts, k AS bars_so_far, {", ".join(f"CASE WHEN k >= 15 THEN {s_round(n)} END AS {n}" for n in (*_BF, *_BF2, *_BF3, "rs_momentum"))} FROM bg""",
)
def _(spark, sf):
    bars = _bars(spark, sf)
    return _out(features.build_features(bars, features.market_bar(bars)), *_BF, *_BF2, *_BF3, "rs_momentum", keys=("symbol", "ts", "bars_so_far"))


@query(
    "read_intraday",
    f"""WITH {HOURLY}, a AS (SELECT upper(symbol) AS symbol, ts + INTERVAL 5 HOUR AS ts, close, volume FROM hourly UNION ALL SELECT upper(symbol), ts + INTERVAL 5 HOUR, close, volume + 1 FROM hourly WHERE hour(ts) = 9)
    SELECT symbol, ts, {s_round("arg_max(close, volume)")} AS close, {s_round("max(volume)")} AS volume FROM a GROUP BY symbol, ts""",
)
def _(spark, sf):
    from ..sources import tables

    folder = new_folder(spark, "intraday")
    bars = tables.hourly_bars(spark, sf).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close", F.col("volume").cast("int"))
    bars.write.parquet(f"{folder}/a")
    bars.where("hour(ts) = 9").withColumn("volume", F.col("volume") + 1).write.parquet(f"{folder}/b")
    found = tables.read_intraday(spark, [f"{folder}/a", f"{folder}/b"], "UTC-05:00")
    return found.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), rounded(F.col("close")).alias("close"), rounded(F.col("volume")).alias("volume"))
