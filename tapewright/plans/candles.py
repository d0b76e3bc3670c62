"""Queries over candles, their outcomes and vectors, and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import frame, full, lag, lead, rounded
from ..operators import candles as ops, features, listings, similarity
from ..sources import tables
from .features import MARKET, _bars, _out
from .registry import BARS, HOURLY, TICKS, W, query, s_frame, s_full, s_lag, s_lead, s_round

_CF = f"""{HOURLY}, a0 AS (SELECT *, abs(close - open) AS body, high - greatest(open, close) AS uw, least(open, close) - low AS lw, close > open AS green, close < open AS red, greatest({s_full(20, "avg(volume)")}, 1) AS vm,
        {", ".join(f"{s_lag(c, n)} AS {c}{n}" for c in ("open", "high", "low", "close") for n in (1, 2))} FROM hourly),
    a1 AS (SELECT *, volume / vm AS vol_ratio, coalesce(high > high1 AND high1 > high2, false) AS higher_high, coalesce(low < low1 AND low1 < low2, false) AS lower_low, coalesce(low > low1 AND low1 > low2, false) AS higher_low,
        coalesce(high < high1 AND high1 < high2, false) AS lower_high, lag(green) OVER ({W}) AS g1, lag(green, 2) OVER ({W}) AS g2, lag(red) OVER ({W}) AS r1, lag(red, 2) OVER ({W}) AS r2 FROM a0)"""
_FLAGS = {
    "high_volume": "vol_ratio > 1.5", "very_high_volume": "vol_ratio > 2.5", "hammer": "lw > 2 * greatest(body, 1e-8) AND uw < greatest(body, 1e-8) AND body > 0", "shooting_star": "uw > 2 * greatest(body, 1e-8) AND lw < greatest(body, 1e-8) AND body > 0",
    "bullish_engulf": "green AND r1 AND open <= close1 AND close >= open1", "bearish_engulf": "red AND g1 AND open >= close1 AND close <= open1", "inside_bar": "high <= high1 AND low >= low1",
    "three_green": "green AND g1 AND g2", "three_red": "red AND r1 AND r2", "higher_high": "higher_high", "lower_low": "lower_low", "higher_low": "higher_low", "lower_high": "lower_high",
}


@query(
    "candle_features",
    f"""WITH {_CF} SELECT symbol, ts, {s_round("vol_ratio")} AS vol_ratio, {s_round("body / greatest(high - low, 1e-8) * 100", 4)} AS body_pct, {", ".join(f"coalesce({r}, false) AS {n}" for n, r in _FLAGS.items())},
    CAST({s_full(3, "sum(higher_high::INT)")} AS INT) AS hh_count, CAST({s_full(3, "sum(lower_low::INT)")} AS INT) AS ll_count FROM a1""",
)
def _(spark, sf):
    out = ops.candle_features(tables.hourly_bars(spark, sf))
    return out.select("symbol", "ts", rounded(F.col("vol_ratio")).alias("vol_ratio"), rounded(F.col("body_pct"), 4).alias("body_pct"), *_FLAGS, "hh_count", "ll_count")


@query(
    "candle_anatomy",
    f"""WITH {HOURLY}, a AS (SELECT *, {s_full(20, "avg(close)")} AS m, {s_full(20, "stddev_samp(close)")} AS s, CAST(sign(close - open) AS INT) AS g, {s_full(20, "avg(high - low)", -1)} AS mr FROM hourly),
    b AS (SELECT *, 4 * s / m * 100 AS bw, (close - (m - 2 * s)) / nullif(4 * s, 0) AS bp, CASE WHEN coalesce(g <> lag(g) OVER ({W}), true) THEN 1 ELSE 0 END AS st FROM a),
    c AS (SELECT *, CASE WHEN count(bw) OVER {s_frame(100)} = 100 THEN quantile_cont(bw, 0.2) OVER {s_frame(100)} END AS q, sum(st) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM b)
    SELECT symbol, ts, {s_round("bw", 4)} AS bb_width, {s_round("bp", 4)} AS bb_place, coalesce(round(bw, 9) <= round(q, 9), false) AS squeeze, CAST(g * row_number() OVER (PARTITION BY symbol, run ORDER BY ts) AS INT) AS streak, {s_round("(high - low) / nullif(mr, 0)", 4)} AS range_expansion FROM c""",
)
def _(spark, sf):
    out = ops.candle_anatomy(tables.hourly_bars(spark, sf))
    return out.select("symbol", "ts", *[rounded(F.col(c), 4).alias(c) for c in ("bb_width", "bb_place", "range_expansion")], "squeeze", "streak")


_AHEAD = lambda n, x: f"CASE WHEN count(*) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) = {n} THEN {x} OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) END"
_CO = [f"ret_{h}" for h in (1, 3, 6, 12, 24)] + ["ret_eod"] + [f"{k}_{w}" for w in (6, 12, 24) for k in ("mfe", "mae")]
_COSQL = f"""{HOURLY}, t AS (SELECT *, high - low AS atr, {", ".join(f"({s_lead('close', h)} / close - 1) * 100 AS ret_{h}" for h in (1, 3, 6, 12, 24))},
        (last_value(close) OVER (PARTITION BY symbol, session ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / close - 1) * 100 AS ret_eod,
        {", ".join(f"({_AHEAD(w, 'max(high)')} / close - 1) * 100 AS mfe_{w}, ({_AHEAD(w, 'min(low)')} / close - 1) * 100 AS mae_{w}" for w in (6, 12, 24))}, {_AHEAD(24, "max(high)")} AS top, {_AHEAD(24, "min(low)")} AS bottom FROM hourly)"""


@query(
    "candle_outcomes",
    f"""WITH {_COSQL} SELECT symbol, ts, {", ".join(f"{s_round(c, 4)} AS {c}" for c in _CO)}, top >= close + 0.5 * atr AS hit_plus_0_5, bottom <= close - 0.5 * atr AS hit_minus_0_5, top >= close + 1.0 * atr AS hit_plus_1_0, bottom <= close - 1.0 * atr AS hit_minus_1_0 FROM t""",
)
def _(spark, sf):
    out = ops.candle_outcomes(tables.hourly_bars(spark, sf).withColumn("atr", F.col("high") - F.col("low")))
    return out.select("symbol", "ts", *[rounded(F.col(c), 4).alias(c) for c in _CO], *[f"hit_{s}_{n}" for n in ("0_5", "1_0") for s in ("plus", "minus")])


_V = f"""{_CF}, v0 AS (SELECT a1.*, hour(ts) * 60 + minute(ts) AS tod, {s_lead("close", 6)} / close - 1 AS ret, CASE WHEN close > {s_full(20, "avg(close)")} THEN 'bull' WHEN close <= {s_full(20, "avg(close)")} THEN 'bear' END AS reg FROM a1),
    vv AS (SELECT symbol, ts, ret, [least(greatest(body / greatest(high - low, 1e-8), 0), 1), least(greatest(uw / greatest(high - low, 1e-8), 0), 1), least(greatest(lw / greatest(high - low, 1e-8), 0), 1), CASE WHEN green THEN 1.0 ELSE 0.0 END,
        least(greatest((high - low) / close * 100 / 3, 0), 1), least(greatest(coalesce(vol_ratio, 1.0) / 4, 0), 1), 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, least(greatest((tod - 570) / 390, 0), 1), 0.5, CASE reg WHEN 'bull' THEN 1.0 WHEN 'bear' THEN 0.0 ELSE 0.5 END, 0.5] AS vec FROM v0)"""


def _vectors(spark, sf):
    rows = ops.candle_features(tables.hourly_bars(spark, sf))
    spread = F.greatest(F.col("high") - F.col("low"), F.lit(1e-8))
    mean = full(20, F.avg("close"), frame(20))
    rows = rows.withColumns(
        {
            "upper_wick_ratio": F.col("upper_wick") / spread, "lower_wick_ratio": F.col("lower_wick") / spread, "is_green": F.col("is_green").cast("double"), "atr_pct": (F.col("high") - F.col("low")) / F.col("close") * 100,
            "tod_min": F.hour("ts") * 60 + F.minute("ts"), "ret": lead("close", 6) / F.col("close") - 1, "daily_regime": F.when(F.col("close") > mean, "bull").when(F.col("close") <= mean, "bear"),
        }
    )
    return ops.candle_vector(rows)


@query("candle_vector", f"WITH {_V} SELECT symbol, ts, {', '.join(f'{s_round(f"vec[{i + 1}]")} AS {n}' for i, n in enumerate(ops.DIMENSIONS))} FROM vv")
def _(spark, sf):
    return _vectors(spark, sf).select("symbol", "ts", *[rounded(F.col("vector")[i]).alias(n) for i, n in enumerate(ops.DIMENSIONS)])


_DIST = f"sqrt(list_sum(list_transform(list_zip(q.vec, m.vec, {list(ops.WEIGHTS)}), lambda z: (z[1] - z[2]) * (z[1] - z[2]) * z[3])))"


@query(
    "similarity_latest",
    f"""WITH {_V}, q AS (SELECT symbol AS query, ts AS query_ts, vec FROM vv QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1),
    d AS (SELECT query, query_ts, m.symbol, m.ts, m.ret, round({_DIST}, 9) AS distance FROM vv m, q WHERE m.ret IS NOT NULL AND m.ts < query_ts),
    k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, symbol, ts) AS rank FROM d)
    SELECT query, query_ts, count(*) AS n, {s_round("avg(ret)")} AS mean, {s_round("avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)")} AS hit_rate,
           string_agg(symbol || '@' || strftime(ts, '%Y-%m-%d %H:%M:%S'), '|' ORDER BY rank) FILTER (rank <= 5) AS nearest FROM k WHERE rank <= 50 GROUP BY query, query_ts""",
)
def _(spark, sf):
    return _out(ops.similarity_latest(_vectors(spark, sf), weights=ops.WEIGHTS), "mean", "hit_rate", keys=("query", "query_ts", "n", "nearest"))


@query(
    "behavior_vector",
    f"""WITH {BARS}, b AS (SELECT *, {s_lag("high")} AS ph, {s_lag("low")} AS pl, open / {s_lag("close")} - 1 AS jump FROM bars)
    SELECT symbol, ts, 3 AS dims, {s_round("CASE WHEN jump > 0.02 THEN least(jump * 10, 1) ELSE 0 END")} AS gap_up, CAST(CASE WHEN high < ph AND low > pl THEN 1 ELSE 0 END AS DOUBLE) AS inside FROM b""",
)
def _(spark, sf):
    bars = _bars(spark, sf).withColumns({"ph": lag("high"), "pl": lag("low"), "jump": F.col("open") / lag("close") - 1})
    fired = bars.select("symbol", "ts", F.inline(F.array(
        F.struct(F.lit("gap_up").alias("behavior"), F.when(F.col("jump") > 0.02, F.least(F.col("jump") * 10, F.lit(1.0))).alias("intensity")),
        F.struct(F.lit("inside").alias("behavior"), F.when((F.col("high") < F.col("ph")) & (F.col("low") > F.col("pl")), 1.0).alias("intensity")),
    ))).where("intensity is not null")
    rows = ops.behavior_vector(bars.select("symbol", "ts", F.array(F.lit(0.5)).alias("vector")), fired, ["inside", "gap_up"])
    return rows.select("symbol", "ts", F.size("vector").alias("dims"), rounded(F.col("vector")[1]).alias("gap_up"), F.col("vector")[2].alias("inside"))


@query(
    "similarity_backtest",
    f"""WITH p AS (SELECT a.vec_id AS query, b.vec_id AS neighbor, b.embedding[1]::DOUBLE AS y, a.embedding[1]::DOUBLE AS truth, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS distance
        FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbor) AS rank FROM p),
    g AS (SELECT k, query, min(truth) AS truth, avg(y) AS guess FROM r, (SELECT unnest([1, 5, 10]) AS k) WHERE rank <= k GROUP BY k, query)
    SELECT CAST(k AS INT) AS k, count(*) AS n, {s_round("avg(CASE WHEN guess * truth > 0 THEN 1.0 ELSE 0.0 END)")} AS hit_rate, {s_round("avg((guess - truth) ** 2)")} AS mse, {s_round("corr(guess, truth)", 5)} AS correlation FROM g GROUP BY k""",
)
def _(spark, sf):
    vectors = tables.read(spark, sf, "embeddings")
    matches = similarity.knn_join(vectors, vectors, 10, ["label"])
    found = ops.similarity_backtest(matches, vectors.select(F.col("vec_id").alias("key"), F.col("embedding")[0].cast("double").alias("y")), (1, 5, 10))
    return found.select("k", "n", rounded(F.col("hit_rate")).alias("hit_rate"), rounded(F.col("mse")).alias("mse"), rounded(F.col("correlation"), 5).alias("correlation"))


@query(
    "quote_asof",
    f"""WITH {TICKS}, q AS (SELECT symbol, ts, price - 0.5 AS bid, price + 1.5 AS ask, event_id FROM ticks WHERE event_id % 7 = 0), t AS (SELECT * FROM ticks WHERE event_id % 7 <> 0)
    SELECT t.event_id, t.symbol, {s_round("(q.bid + q.ask) / 2")} AS mid FROM t ASOF LEFT JOIN q ON t.symbol = q.symbol AND t.ts >= q.ts""",
)
def _(spark, sf):
    ticks = tables.ticks(spark, sf)
    quotes = ticks.where("event_id % 7 = 0").select("symbol", "ts", (F.col("price") - 0.5).alias("bid"), (F.col("price") + 1.5).alias("ask"))
    return _out(ops.quote_asof(ticks.where("event_id % 7 <> 0"), quotes), "mid", keys=("event_id", "symbol"))


@query("normalize_symbols", "SELECT p_partkey, replace(p_brand, '#', '.') AS symbol, replace(replace(p_brand, '#', '.'), '.', '-') AS vendor_symbol FROM part")
def _(spark, sf):
    parts = tables.read(spark, sf, "part").select("p_partkey", F.replace("p_brand", F.lit("#"), F.lit(".")).alias("symbol"))
    return ops.normalize_symbols(parts)


_TF = {"wide": "high > low * 1.5", "green": "close > open", "heavy": "volume >= 60"}


@query("template_filter", f"WITH {BARS} SELECT symbol, ts, {', '.join(f'coalesce({r}, false) AS {n}' for n, r in _TF.items())}, concat_ws('|', {', '.join(f"CASE WHEN {r} THEN '{n}' END" for n, r in _TF.items())}) AS templates FROM bars")
def _(spark, sf):
    return ops.template_filter(_bars(spark, sf), {n: F.expr(r) for n, r in _TF.items()}).select("symbol", "ts", *_TF, "templates")


#: Every brand's weekly bars count as a listing of its first week after 1994.
_LP = f"""{BARS}, {MARKET}, bm AS (SELECT ts, b, CASE WHEN b > avg(b) OVER (ORDER BY ts ROWS 49 PRECEDING) THEN 'bull' ELSE 'bear' END AS regime FROM market),
    li AS (SELECT symbol, CAST(min(ts) AS DATE) + 100 AS listed FROM bars GROUP BY symbol),
    si AS (SELECT bars.*, listed, row_number() OVER (PARTITION BY bars.symbol ORDER BY bars.ts) - 1 AS idx FROM bars JOIN li ON bars.symbol = li.symbol WHERE bars.ts >= listed),
    s2 AS (SELECT si.*, max(CASE WHEN idx = 0 THEN open END) OVER (PARTITION BY symbol) AS o0, max(CASE WHEN idx = 0 THEN close END) OVER (PARTITION BY symbol) AS c0, bm.b, bm.regime FROM si LEFT JOIN bm USING (ts)),
    s3 AS (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY idx ROWS UNBOUNDED PRECEDING) AS top, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY idx)) AS r FROM s2 WHERE idx <= 252),
    lp AS (SELECT symbol, listed, count(*) AS bars, {", ".join(f"(max(close) FILTER (idx = {h}) / max(close) FILTER (idx = 0) - 1) * 100 AS ret_{h}d, (max(close) FILTER (idx = {h}) / max(close) FILTER (idx = 0) - 1) * 100 - (max(b) FILTER (idx = {h}) / max(b) FILTER (idx = 0) - 1) * 100 AS rel_{h}d" for h in listings.HORIZONS)},
        min((close / top - 1) * 100) AS max_drawdown, (max(high) / max(o0) - 1) * 100 AS peak_pct, CAST(first(idx ORDER BY high DESC, idx) AS INT) AS peak_idx, avg(volume) FILTER (idx BETWEEN 16 AND 20) / avg(volume) FILTER (idx BETWEEN 0 AND 4) - 1 AS volume_decay,
        {", ".join(f"CASE WHEN count(r) FILTER (idx <= {n}) >= 5 THEN stddev_samp(r) FILTER (idx <= {n}) * sqrt(252.0) * 100 END AS vol_{n}" for n in (30, 90))}, first(regime ORDER BY idx) AS regime, (max(c0) / max(o0) - 1) * 100 AS pop_pct FROM s3 GROUP BY symbol, listed),
    l2 AS (SELECT *, CASE WHEN ret_252d >= 50 THEN 'winner' WHEN ret_252d >= 0 THEN 'moderate' WHEN ret_252d >= -50 THEN 'loser' WHEN ret_252d IS NOT NULL THEN 'disaster' END AS year1 FROM lp)"""
_LN = [f"{k}_{h}d" for h in listings.HORIZONS for k in ("ret", "rel")] + ["max_drawdown", "peak_pct", "volume_decay", "vol_30", "vol_90", "pop_pct"]


def _listed(spark, sf):
    bars = _bars(spark, sf)
    market = features.market_bar(bars)
    market = market.withColumn("regime", F.when(F.col("close") > F.avg("close").over(frame(50)), "bull").otherwise("bear"))
    return bars.groupBy("symbol").agg(F.date_add(F.min("ts"), 100).alias("listed")), bars, market


@query("listing_performance", f"WITH {_LP} SELECT symbol, listed, bars, peak_idx, regime, year1, {', '.join(f'{s_round(c, 4)} AS {c}' for c in _LN)} FROM l2")
def _(spark, sf):
    return _out(listings.listing_performance(*_listed(spark, sf)), *_LN, keys=("symbol", "listed", "bars", "peak_idx", "regime", "year1"), digits=4)


_POP = "CASE WHEN pop_pct >= 10 THEN 'hot' WHEN pop_pct >= 0 THEN 'warm' ELSE 'broken' END"


@query(
    "listing_studies",
    f"""WITH {_LP}, l AS (SELECT 'overall' AS study, 'all' AS bucket, ret_21d AS v FROM l2 UNION ALL SELECT 'pop', {_POP}, ret_21d FROM l2 UNION ALL SELECT 'week1', CASE WHEN ret_5d > 0 THEN 'up' ELSE 'down' END, ret_21d FROM l2)
    SELECT study, bucket, count(*) AS n, {s_round("avg(v)", 4)} AS mean, {s_round("quantile_cont(v, 0.5)", 4)} AS median, {s_round("avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END)", 4)} AS share_up FROM l WHERE v IS NOT NULL GROUP BY study, bucket HAVING count(*) >= 1""",
)
def _(spark, sf):
    pop = F.when(F.col("pop_pct") >= 10, "hot").when(F.col("pop_pct") >= 0, "warm").otherwise("broken")
    buckets = {"pop": pop, "week1": F.when(F.col("ret_5d") > 0, "up").otherwise("down")}
    return _out(listings.listing_studies(listings.listing_performance(*_listed(spark, sf)), buckets, "ret_21d", 1), "mean", "median", "share_up", keys=("study", "bucket", "n"), digits=4)


@query(
    "listing_breakdowns",
    f"""WITH {_LP}, k AS ({" UNION ALL ".join(f"SELECT 'all' AS key, 'all' AS value, {h} AS horizon, ret_{h}d AS r FROM l2 UNION ALL SELECT 'regime', regime, {h}, ret_{h}d FROM l2 UNION ALL SELECT 'year1', year1, {h}, ret_{h}d FROM l2" for h in (5, 21, 63, 252))})
    SELECT key, value, horizon, count(*) AS n, {s_round("avg(r)", 4)} AS mean, {s_round("quantile_cont(r, 0.5)", 4)} AS median, {s_round("avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END)", 4)} AS win_rate FROM k WHERE r IS NOT NULL AND value IS NOT NULL GROUP BY key, value, horizon""",
)
def _(spark, sf):
    found = listings.listing_breakdowns(listings.listing_performance(*_listed(spark, sf)), (5, 21, 63, 252), ("regime", "year1"))
    return _out(found, "mean", "median", "win_rate", keys=("key", "value", "horizon", "n"), digits=4)


@query(
    "window_returns",
    f"""WITH {_LP}, wk AS (SELECT symbol, avg(volume) AS w FROM si WHERE idx < 5 GROUP BY symbol), sp AS (SELECT unnest([116, 121, 126]) AS "first", unnest([125, 131, 136]) AS "last"),
    m AS (SELECT symbol, "first", "last", arg_max(close, idx) / arg_min(close, idx) - 1 AS r, avg(volume) AS v, count(*) AS bars FROM si, sp WHERE idx BETWEEN "first" AND "last" GROUP BY ALL)
    SELECT symbol, "first", "last", bars, {s_round("r * 100", 4)} AS ret, {s_round("v / w", 4)} AS volume_ratio FROM m JOIN wk USING (symbol)""",
)
def _(spark, sf):
    names, bars, _ = _listed(spark, sf)
    return _out(listings.window_returns(names, bars, 126, [(-10, -1), (-5, 5), (0, 10)]), "ret", "volume_ratio", keys=("symbol", "first", "last", "bars"), digits=4)
