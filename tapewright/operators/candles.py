"""Shape, volume and structure of intraday bars, what followed them, and their vectors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import ahead, by_symbol, frame, full, lag
from .similarity import distance


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def candle_features(bars: DataFrame) -> DataFrame:
    """Volume against its mean, body and wicks, one- and two-bar shapes, and the trend of highs and lows."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    mean = F.greatest(full(20, F.avg("volume"), frame(20)), F.lit(1.0))
    rows = bars.withColumns({"vol_ratio": F.col("volume") / mean, "body": F.abs(c - o), "upper_wick": h - F.greatest(o, c), "lower_wick": F.least(o, c) - low, "is_green": c > o, "is_red": c < o})
    body, up, down = F.col("body"), F.col("upper_wick"), F.col("lower_wick")
    some = F.greatest(body, F.lit(1e-8))
    green, red, p_open, p_close = F.col("is_green"), F.col("is_red"), lag("open"), lag("close")
    step = {"higher_high": (h > lag("high")) & (lag("high") > lag("high", 2)), "lower_low": (low < lag("low")) & (lag("low") < lag("low", 2))}
    step |= {"higher_low": (low > lag("low")) & (lag("low") > lag("low", 2)), "lower_high": (h < lag("high")) & (lag("high") < lag("high", 2))}
    rows = rows.withColumns(
        {
            "high_volume": _known(F.col("vol_ratio") > 1.5), "very_high_volume": _known(F.col("vol_ratio") > 2.5), "body_pct": body / F.greatest(h - low, F.lit(1e-8)) * 100,
            "hammer": (down > 2 * some) & (up < some) & (body > 0), "shooting_star": (up > 2 * some) & (down < some) & (body > 0),
            "bullish_engulf": _known(green & lag("is_red") & (o <= p_close) & (c >= p_open)), "bearish_engulf": _known(red & lag("is_green") & (o >= p_close) & (c <= p_open)),
            "inside_bar": _known((h <= lag("high")) & (low >= lag("low"))),
            "three_green": _known(green & lag("is_green") & lag("is_green", 2)), "three_red": _known(red & lag("is_red") & lag("is_red", 2)),
        }
        | {n: _known(rule) for n, rule in step.items()}
    )
    count = lambda name: F.when(F.count(F.lit(1)).over(frame(3)) == 3, F.sum(F.col(name).cast("int")).over(frame(3)))
    return rows.withColumns({"hh_count": count("higher_high"), "ll_count": count("lower_low")})


def candle_anatomy(bars: DataFrame, n: int = 20) -> DataFrame:
    """Bollinger place and width, whether the width is in its lowest fifth of 100 bars, the signed streak, and the range against its mean."""
    mean, deviation = full(n, F.avg("close"), frame(n)), full(n, F.stddev_samp("close"), frame(n))
    rows = bars.withColumns({"_m": mean, "_s": deviation, "_g": F.signum(F.col("close") - F.col("open")).cast("int")})
    rows = rows.withColumns({"bb_width": 4 * F.col("_s") / F.col("_m") * 100, "bb_place": (F.col("close") - (F.col("_m") - 2 * F.col("_s"))) / F.nullif(4 * F.col("_s"), F.lit(0.0))})
    quiet = F.when(F.count("bb_width").over(frame(100)) == 100, F.percentile("bb_width", F.lit(0.2)).over(frame(100)))
    start = F.when(F.coalesce(F.col("_g") != lag("_g"), F.lit(True)), 1).otherwise(0)
    rows = rows.withColumns({"squeeze": _known(F.col("bb_width") <= quiet), "_run": F.sum(start).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))})
    place = F.row_number().over(Window.partitionBy("symbol", "_run").orderBy("ts"))
    spread = F.col("high") - F.col("low")
    rows = rows.withColumns({"streak": F.col("_g") * place, "range_expansion": spread / F.nullif(full(n, F.avg(spread), frame(n, -1)), F.lit(0.0))})
    return rows.drop("_m", "_s", "_g", "_run")


def candle_outcomes(bars: DataFrame, horizons: Iterable[int] = (1, 3, 6, 12, 24), windows: Iterable[int] = (6, 12, 24), atr: str = "atr") -> DataFrame:
    """Returns after some bars and at the session's end, best and worst excursions, and which of half and one ATR is reached in 24 bars; nights included."""
    c = F.col("close")
    percent = lambda x: (x / c - 1) * 100
    whole = lambda n, x: F.when((F.count(F.lit(1)).over(ahead(1, n)) == n) & (c > 0), x.over(ahead(1, n)))
    top, bottom = whole(24, F.max("high")), whole(24, F.min("low"))
    end = F.last("close").over(Window.partitionBy("symbol", "session").orderBy("ts").rowsBetween(0, Window.unboundedFollowing))
    columns = {f"ret_{h}": percent(F.lead("close", h).over(by_symbol())) for h in horizons} | {"ret_eod": percent(end)}
    columns |= {f"mfe_{w}": percent(whole(w, F.max("high"))) for w in windows} | {f"mae_{w}": percent(whole(w, F.min("low"))) for w in windows}
    for name, share in (("0_5", 0.5), ("1_0", 1.0)):
        columns[f"hit_plus_{name}"] = top >= c + share * F.col(atr)
        columns[f"hit_minus_{name}"] = bottom <= c - share * F.col(atr)
    return bars.withColumns(columns)


#: Dimensions of a candle's vector in order, and their weights in the distance (fixed values).
DIMENSIONS = ("body", "upper_wick", "lower_wick", "direction", "range", "rel_vol", "vol_zscore", "vwap_dist", "or_pos", "ema9_slope", "rsi", "macd", "time", "conviction", "regime", "vix")
WEIGHTS = (1.0, 1.0, 1.0, 1.0, 0.5, 1.5, 1.5, 1.0, 1.0, 0.75, 0.75, 0.5, 2.0, 2.0, 2.0, 1.5)
CONVICTION = {"VERY_HIGH": 1.00, "HIGH": 0.75, "MODERATE": 0.50, "LOW": 0.25, "VERY_LOW": 0.10}
REGIME = {"bull": 1.0, "bullish": 1.0, "neutral": 0.5, "bearish": 0.0, "bear": 0.0}
VIX = {"low": 1.00, "moderate": 0.50, "high": 0.25, "extreme": 0.00}


def candle_vector(rows: DataFrame) -> DataFrame:
    """Add ``vector``: 16 features scaled and cut to 0-1; a column that is missing or null has a neutral value."""
    have = set(rows.columns)

    def number(name: str, default: float) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in have else F.lit(default)

    def mapped(name: str, table: dict[str, float]) -> Column:
        if name not in have:
            return F.lit(0.5)
        out = F.lit(0.5)
        for key, value in table.items():
            out = F.when(F.lower(name) == key.lower(), value).otherwise(out)
        return out

    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    atr = F.greatest(number("atr14", 0.1), F.lit(1e-8))
    place = F.when(number("above_or_high", 0.0) > 0.5, 1.0).when(number("below_or_low", 0.0) > 0.5, 0.0).otherwise(0.5)
    parts = [
        unit(number("body_pct", 50.0) / 100), unit(number("upper_wick_ratio", 0.0)), unit(number("lower_wick_ratio", 0.0)), F.when(number("is_green", 0.5) > 0.5, 1.0).otherwise(0.0), unit(number("atr_pct", 0.3) / 3),
        unit(number("vol_ratio", 1.0) / 4), unit((number("vol_zscore", 0.0) + 4) / 8), unit((number("dist_vwap_pct", 0.0) + 3) / 6), place, unit((number("ema9_slope", 0.0) / atr + 2) / 4),
        unit(number("rsi14", 50.0) / 100), unit((number("macd_hist", 0.0) / atr + 2) / 4), unit((number("tod_min", 765.0) - 570) / 390), mapped("daily_conviction", CONVICTION), mapped("daily_regime", REGIME), mapped("daily_vix", VIX),
    ]
    return rows.withColumn("vector", F.array(*parts))


def behavior_vector(rows: DataFrame, behaviors: DataFrame, names: list[str], vector: str = "vector") -> DataFrame:
    """Append the intensities of the named behaviours, by name, to each row's vector; one that did not fire is 0."""
    found = behaviors.groupBy("symbol", "ts").agg(F.map_from_entries(F.collect_list(F.struct("behavior", "intensity"))).alias("_b"))
    values = F.array(*[F.coalesce(F.col("_b")[n], F.lit(0.0)) for n in sorted(names)])
    return rows.join(found, ["symbol", "ts"], "left").withColumn(vector, F.concat(vector, values)).drop("_b")


def similarity_latest(rows: DataFrame, k: int = 50, shown: int = 5, vector: str = "vector", weights: Iterable[float] | None = None) -> DataFrame:
    """The newest candle of each symbol against all earlier candles: the nearest ``k``, the first few as text, and their mean outcome ``ret``.

    Queries are one row a symbol; memory rows meet the symbols' queries in blocks,
    and each task keeps its best ``k`` of a query before the shuffle.
    """
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    queries = rows.withColumn("_n", newest).where("_n = 1").select(F.col("symbol").alias("query"), F.col("ts").alias("query_ts"), F.col(vector).alias("_q"))
    # One equal key: every memory row meets every query, one a symbol.
    met = rows.where("ret is not null").withColumn("_one", F.lit(1)).join(queries.withColumn("_one", F.lit(1)), "_one").where(F.col("ts") < F.col("query_ts"))
    weights = list(weights) if weights is not None else None
    met = met.select("query", "query_ts", "symbol", "ts", "ret", F.round(distance(F.col("_q"), F.col(vector), weights), 9).alias("distance"))
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "symbol", "ts"))).where(F.col("rank") <= k)
    name = F.concat_ws("@", "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= shown, F.struct("rank", name.alias("name"))))), lambda x: x["name"]), "|")
    return best.groupBy("query", "query_ts").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean"), F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"), top.alias("nearest"))


def similarity_backtest(matches: DataFrame, outcomes: DataFrame, sizes: Iterable[int]) -> DataFrame:
    """For several ``k`` from one search at the largest: hit rate of the neighbours' mean as a forecast, error and correlation.

    ``matches`` has ``query, rank, neighbor``, ``outcomes`` has ``key, y``. Every
    query with a neighbour counts; one whose forecast or outcome is unknown is no hit
    and has no part in error and correlation.
    """
    y = outcomes.select(F.col("key").alias("neighbor"), F.col("y").alias("_n"))
    truth = outcomes.select(F.col("key").alias("query"), F.col("y").alias("truth"))
    sums = matches.join(y, "neighbor").groupBy("query").agg(*[F.avg(F.when(F.col("rank") <= k, F.col("_n"))).alias(f"p{k}") for k in sizes]).join(truth, "query")
    long = sums.select("truth", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("guess")) for k in sizes])))
    # Of pairs that are known on both sides.
    spread = F.stddev_pop(F.when(F.col("truth").isNotNull(), F.col("guess"))) * F.stddev_pop(F.when(F.col("guess").isNotNull(), F.col("truth")))
    both = F.covar_pop("guess", "truth") / F.nullif(spread, F.lit(0.0))
    return long.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.avg(_known(F.col("guess") * F.col("truth") > 0).cast("double")).alias("hit_rate"), F.avg((F.col("guess") - F.col("truth")) ** 2).alias("mse"), both.alias("correlation"),
    )


def quote_asof(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Each trade with the mid price of the last quote at or before it (``bid, ask``), by one union and one window a symbol."""
    both = trades.withColumns({"_mid": F.lit(None).cast("double"), "_o": F.lit(1)}).unionByName(quotes.select("symbol", "ts", ((F.col("bid") + F.col("ask")) / 2).alias("_mid"), F.lit(0).alias("_o")), allowMissingColumns=True)
    run = Window.partitionBy("symbol").orderBy("ts", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("mid", F.last("_mid", ignorenulls=True).over(run)).where("_o = 1").drop("_mid", "_o")


def normalize_symbols(rows: DataFrame, column: str = "symbol") -> DataFrame:
    """Share-class dots as dashes, as one vendor writes them; the table's own name stays beside it."""
    return rows.withColumn(f"vendor_{column}", F.replace(F.col(column), F.lit("."), F.lit("-")))


def template_filter(trades: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """Add one boolean for each named predicate (false where unknown), and ``templates``, the names of those that hold."""
    rows = trades.withColumns({n: _known(c) for n, c in predicates.items()})
    return rows.withColumn("templates", F.concat_ws("|", *[F.when(F.col(n), F.lit(n)) for n in predicates]))
