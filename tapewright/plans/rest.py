"""Queries over votes, sessions, order flow, similarity and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import rounded
from ..operators import intraday, similarity, texts
from ..sources import tables
from .features import _bars, _out
from .registry import BARS, HOURLY, TICKS, query, s_round

_S = "PARTITION BY symbol, session ORDER BY ts"


def _hours(spark, sf):
    return tables.hourly_bars(spark, sf)


@query(
    "session_columns",
    f"""WITH {HOURLY} SELECT symbol, ts, session, CAST(hour(ts) * 60 + minute(ts) AS INT) AS minute, CAST(row_number() OVER ({_S}) AS INT) AS candle_number,
    CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS time_bucket FROM hourly""",
)
def _(spark, sf):
    return intraday.session_columns(_hours(spark, sf)).select("symbol", "ts", "session", "minute", "candle_number", "time_bucket")


@query(
    "session_vwap",
    f"""WITH {HOURLY}, c AS (SELECT *, sum((high + low + close) / 3 * volume) OVER ({_S}) AS pv, sum(volume) OVER ({_S}) AS v FROM hourly), w AS (SELECT symbol, ts, close, CASE WHEN v > 0 THEN pv / v END AS vwap FROM c),
    a AS (SELECT *, round(close - vwap, 9) > 0 AS above, lag(round(close - vwap, 9) > 0) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM w)
    SELECT symbol, ts, {s_round("vwap")} AS vwap, {s_round("close / vwap - 1")} AS vwap_distance, coalesce(above AND NOT before, false) AS cross_up, coalesce(NOT above AND before, false) AS cross_down FROM a""",
)
def _(spark, sf):
    out = intraday.session_vwap(_hours(spark, sf))
    return out.select("symbol", "ts", rounded(F.col("vwap")).alias("vwap"), rounded(F.col("vwap_distance")).alias("vwap_distance"), "cross_up", "cross_down")


@query(
    "opening_range",
    f"""WITH {HOURLY}, k AS (SELECT *, row_number() OVER ({_S}) AS k FROM hourly), r AS (SELECT *, CASE WHEN k > 6 THEN max(CASE WHEN k <= 6 THEN high END) OVER (PARTITION BY symbol, session) END AS h, CASE WHEN k > 6 THEN min(CASE WHEN k <= 6 THEN low END) OVER (PARTITION BY symbol, session) END AS l FROM k),
    b AS (SELECT *, coalesce(close > h, false)::INT AS u, coalesce(close < l, false)::INT AS d FROM r)
    SELECT symbol, ts, {s_round("h")} AS or_high, {s_round("l")} AS or_low, u = 1 AND sum(u) OVER ({_S}) = 1 AS break_up, d = 1 AND sum(d) OVER ({_S}) = 1 AS break_down FROM b""",
)
def _(spark, sf):
    out = intraday.opening_range(_hours(spark, sf))
    return out.select("symbol", "ts", rounded(F.col("or_high")).alias("or_high"), rounded(F.col("or_low")).alias("or_low"), "break_up", "break_down")


@query(
    "session_gap",
    f"""WITH {HOURLY}, d AS (SELECT symbol, session, arg_min(open, ts) AS o, arg_max(close, ts) AS c FROM hourly GROUP BY symbol, session)
    SELECT symbol, session, {s_round("CASE WHEN session - lag(session) OVER (PARTITION BY symbol ORDER BY session) <= 7 THEN (o / lag(c) OVER (PARTITION BY symbol ORDER BY session) - 1) * 100 END")} AS gap_pct FROM d""",
)
def _(spark, sf):
    return _out(intraday.session_gap(_hours(spark, sf)), "gap_pct", keys=("symbol", "session"))


_DIR = f"""{TICKS}, st AS (SELECT *, CAST(sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, event_id)) AS INT) AS s FROM ticks),
    dr AS (SELECT *, coalesce(last_value(CASE WHEN s <> 0 THEN s END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS direction FROM st)"""


@query("tick_direction", f"WITH {_DIR} SELECT event_id, symbol, direction FROM dr")
def _(spark, sf):
    return intraday.tick_direction(tables.ticks(spark, sf)).select("event_id", "symbol", "direction")


_FOOT = f"""{_DIR}, cells AS (SELECT symbol, date_trunc('hour', ts) AS bar, floor(price / 10.0) * 10.0 AS bucket, CAST(sum(CASE WHEN direction > 0 THEN size ELSE 0 END) AS BIGINT) AS buy,
    CAST(sum(CASE WHEN direction < 0 THEN size ELSE 0 END) AS BIGINT) AS sell, count(*) AS n FROM dr GROUP BY 1, 2, 3)"""


@query("footprint", f"WITH {_FOOT} SELECT symbol, bar, {s_round('bucket')} AS bucket, buy, sell, n, buy - sell AS delta FROM cells")
def _(spark, sf):
    return _out(intraday.footprint(intraday.tick_direction(tables.ticks(spark, sf))), "bucket", keys=("symbol", "bar", "buy", "sell", "n", "delta"))


@query(
    "footprint_summary",
    f"""WITH {_FOOT}, b AS (SELECT symbol, bar, CAST(sum(buy) AS BIGINT) AS buy, CAST(sum(sell) AS BIGINT) AS sell, CAST(sum(buy - sell) AS BIGINT) AS delta, first(bucket ORDER BY buy + sell DESC, bucket) AS poc FROM cells GROUP BY symbol, bar)
    SELECT symbol, bar, buy, sell, delta, {s_round("poc")} AS poc, {s_round("CASE WHEN buy + sell > 0 THEN 100.0 * buy / (buy + sell) END")} AS buy_pct,
           CAST(sum(delta) OVER (PARTITION BY symbol, CAST(bar AS DATE) ORDER BY bar) AS BIGINT) AS cum_delta FROM b""",
)
def _(spark, sf):
    out = intraday.footprint_summary(intraday.footprint(intraday.tick_direction(tables.ticks(spark, sf))))
    return _out(out, "poc", "buy_pct", keys=("symbol", "bar", "buy", "sell", "delta", "cum_delta"))


_FIRST = lambda rule: f"list_position(list_transform(p, lambda x: {rule}), true)"


@query(
    "bar_outcomes",
    f"""WITH {BARS}, p AS (SELECT *, list({{'high': high, 'low': low}}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS p, lead(close, 6) OVER (PARTITION BY symbol ORDER BY ts) AS later FROM bars),
    h AS (SELECT *, nullif({_FIRST("x.high >= close + (high - low)")}, 0) AS hit, nullif({_FIRST("x.low <= close - (high - low)")}, 0) AS stop FROM p WHERE len(p) > 0),
    t AS (SELECT *, hit IS NOT NULL AND (stop IS NULL OR hit < stop) AS target FROM h)
    SELECT symbol, ts, {s_round("(later / close - 1) * 100")} AS ret, {s_round("(list_max(list_transform(p, lambda x: x.high)) / close - 1) * 100")} AS mfe, {s_round("(list_min(list_transform(p, lambda x: x.low)) / close - 1) * 100")} AS mae,
           target AS target_hit, stop IS NOT NULL AND NOT target AS stop_hit, CAST(CASE WHEN target THEN hit ELSE stop END AS INT) AS bars_to_hit FROM t""",
)
def _(spark, sf):
    out = intraday.bar_outcomes(_bars(spark, sf))
    return out.select("symbol", "ts", *[rounded(F.col(c)).alias(c) for c in ("ret", "mfe", "mae")], "target_hit", "stop_hit", "bars_to_hit")


@query(
    "knn_join",
    f"""WITH p AS (SELECT a.vec_id AS query, b.vec_id AS neighbor, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS distance
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbor) AS rank FROM p)
    SELECT query, CAST(rank AS INT) AS rank, neighbor, {s_round("distance")} AS distance FROM k WHERE rank <= 10""",
)
def _(spark, sf):
    vectors = tables.read(spark, sf, "embeddings")
    return _out(similarity.knn_join(vectors.where("vec_id % 20 = 0"), vectors, 10, ["label"]), "distance", keys=("query", "rank", "neighbor"))


@query(
    "neighbor_outcomes",
    f"""WITH p AS (SELECT a.vec_id AS query, b.vec_id AS neighbor, b.embedding[1]::DOUBLE AS y, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS distance
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbor) AS rank FROM p)
    SELECT query, count(*) AS n, {s_round("avg(y)")} AS mean, {s_round("quantile_cont(y, 0.5)")} AS median, {s_round("avg(CASE WHEN y > 0 THEN 1 ELSE 0 END)")} AS hit_rate, {s_round("stddev_samp(y)")} AS std FROM k WHERE rank <= 10 GROUP BY query HAVING count(*) >= 3""",
)
def _(spark, sf):
    vectors = tables.read(spark, sf, "embeddings")
    matches = similarity.knn_join(vectors.where("vec_id % 20 = 0"), vectors, 10, ["label"])
    later = vectors.select("vec_id", F.col("embedding")[0].cast("double").alias("y"))
    return _out(similarity.neighbor_outcomes(matches, later, "vec_id", "y"), "mean", "median", "hit_rate", "std", keys=("query", "n"))


_SENT = """s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\\n]+')) AS sentence, generate_subscripts(regexp_split_to_array(text, '[.!?\\n]+'), 1) - 1 AS place FROM documents),
    t AS (SELECT doc_id, CAST(place AS INT) AS place, regexp_replace(sentence, '^[ \\t]+|[ \\t]+$', '', 'g') AS sentence FROM s)"""


@query("split_sentences", f"WITH {_SENT} SELECT doc_id, place, sentence FROM t WHERE length(sentence) > 10")
def _(spark, sf):
    return texts.split_sentences(tables.read(spark, sf, "documents"))


#: The corpus is invented prose, so conditions are also looked for in sentences that the tables' own values spell out.
_CLAIMS_SQL = """claims AS (SELECT o_orderkey AS doc_id, 'After ' || (o_orderkey % 13) || ' red days the market turns. It gaps up ' || round(o_totalprice / 10000, 1) || '% often. Buy within ' || (o_orderkey % 25) || '% of its 52-week low!'
    || CASE o_orderkey % 8 WHEN 0 THEN ' A hammer or a shooting star may follow. It fell 4 days in a row.' WHEN 1 THEN ' They saw 3 straight up sessions and a doji there.' WHEN 2 THEN ' Prices gapped down over 1,5 percent.' WHEN 3 THEN ' A bullish engulfing bar on an inside day.'
       WHEN 4 THEN ' The index rallied 3 days, then an outside day.' WHEN 5 THEN ' We count 5 consecutive down days with bearish engulfing bars.' ELSE '' END AS text FROM orders)"""


def _claims(spark, sf):
    orders = tables.read(spark, sf, "orders")
    text = F.concat(F.lit("After "), (F.col("o_orderkey") % 13).cast("string"), F.lit(" red days the market turns. It gaps up "), F.round(F.col("o_totalprice") / 10000, 1).cast("string"), F.lit("% often. Buy within "), (F.col("o_orderkey") % 25).cast("string"), F.lit("% of its 52-week low!"))
    more = [" A hammer or a shooting star may follow. It fell 4 days in a row.", " They saw 3 straight up sessions and a doji there.", " Prices gapped down over 1,5 percent.", " A bullish engulfing bar on an inside day.", " The index rallied 3 days, then an outside day.", " We count 5 consecutive down days with bearish engulfing bars."]
    tail = F.coalesce(F.get(F.array(*[F.lit(m) for m in more]), (F.col("o_orderkey") % 8).cast("int")), F.lit(""))
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(text, tail).alias("text"))


_EXTRACT = " UNION ALL ".join(
    [f"SELECT doc_id, place, '{n}' AS condition, '{p}' AS parameter, try_cast(replace(nullif(regexp_extract(lower(sentence), '{r}', 1), ''), ',', '.') AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS detail, '{d}' AS direction FROM t WHERE length(sentence) > 10" for n, r, p, d in texts.RULES]
    + [f"SELECT doc_id, place, 'candle', 'pattern', NULL, '{n}', '{d}' FROM t WHERE length(sentence) > 10 AND regexp_matches(lower(sentence), '{r}')" for r, n, d in texts.CANDLES]
)
_FOUND = f"x AS ({_EXTRACT}) SELECT doc_id, condition, parameter, {s_round('value')} AS value, detail, direction FROM x WHERE detail IS NOT NULL OR value BETWEEN CASE WHEN parameter = 'n' THEN 2 ELSE 0.1 END AND CASE WHEN parameter = 'n' THEN 10 ELSE 20 END QUALIFY row_number() OVER (PARTITION BY doc_id, condition, value, detail ORDER BY place) = 1"


@query("extract_conditions", f"WITH {_CLAIMS_SQL}, {_SENT.replace('FROM documents', 'FROM claims')}, {_FOUND}")
def _(spark, sf):
    return _out(texts.extract_conditions(_claims(spark, sf)), "value", keys=("doc_id", "condition", "parameter", "detail", "direction"))


@query("extract_conditions_documents", f"WITH docs AS (SELECT doc_id, text || ' ' || CASE WHEN doc_id % 50 = 0 THEN '. It dropped 3 sessions before.' ELSE '' END AS text FROM documents), {_SENT.replace('FROM documents', 'FROM docs')}, {_FOUND}")
def _(spark, sf):
    more = F.when(F.col("doc_id") % 50 == 0, ". It dropped 3 sessions before.").otherwise("")
    docs = tables.read(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(" "), more).alias("text"))
    return _out(texts.extract_conditions(docs), "value", keys=("doc_id", "condition", "parameter", "detail", "direction"))
