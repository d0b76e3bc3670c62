"""Regimes, reliability, calibration, lifts, listings and set-ups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import by_symbol, frame, full, lag, sum_before
from .cross_section import EPSILON, daily_ic, ic_summary
from .outcomes import normal_tail


def calendar_dim(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Third-Friday expiries, quarterly witching, and quarter and half-year ends: ``date, event_type``."""
    months = spark.sql(f"SELECT explode(sequence(date'{first_year}-01-01', date'{last_year}-12-01', interval 1 month)) AS m")
    third = F.date_add(F.next_day(F.date_sub("m", 1), "Fri"), 14)
    events = F.array(
        F.struct(third.alias("date"), F.lit("expiry").alias("event_type")),
        F.struct(F.when(F.month("m") % 3 == 0, third).alias("date"), F.lit("witching").alias("event_type")),
        F.struct(F.when(F.month("m") % 3 == 0, F.last_day("m")).alias("date"), F.lit("quarter_end").alias("event_type")),
        F.struct(F.when(F.month("m") % 6 == 0, F.last_day("m")).alias("date"), F.lit("half_year_end").alias("event_type")),
    )
    return months.select(F.inline(events)).where("date is not null")


def calendar_context(bars: DataFrame, events: DataFrame, event_type: str = "expiry") -> DataFrame:
    """Signed days to the nearest event within a month (ties: the later one) and whether it is in this week.

    Each event is spread over the days around it, so that dates meet it by an equal key.
    """
    dates = bars.select("ts").distinct()
    days = events.where(F.col("event_type") == event_type).select(F.col("date").alias("_d"), F.explode(F.sequence(F.date_sub("date", 31), F.date_add("date", 31))).alias("_at"))
    met = dates.join(days, F.to_date("ts") == F.col("_at")).withColumn("_n", F.datediff("_d", "ts"))
    near = met.groupBy("ts").agg(F.min_by("_n", F.struct(F.abs("_n"), -F.col("_n"))).alias("days_to_event"), F.max((F.date_trunc("week", "_d") == F.date_trunc("week", "ts")).cast("int")).alias("event_week"))
    return bars.join(near, "ts", "left").withColumn("event_week", F.coalesce(F.col("event_week") == 1, F.lit(False)))


def regime_ic(rows: DataFrame, features: Iterable[str], target: str, regimes: DataFrame) -> DataFrame:
    """Rank ICs by regime of the date (``ts, regime``; a date may be in several)."""
    ics = daily_ic(rows, features, target).join(regimes, "ts")
    out = ics.groupBy("feature", "regime").agg(F.avg("ic").alias("mean_ic"), F.avg((F.col("ic") > EPSILON).cast("int")).alias("positive"), F.count(F.lit(1)).alias("n_dates"))
    kind = F.when((F.col("n_dates") >= 20) & (F.abs("mean_ic") >= 0.03), F.when(F.col("mean_ic") > 0, "useful").otherwise("inverse")).otherwise("noise")
    return out.withColumn("kind", kind)


def feature_reliability(ics: DataFrame, windows: Iterable[int] = (30, 90, 180)) -> DataFrame:
    """Mean IC of each feature over its last dates, for several windows, and the trend between the first two."""
    place = F.dense_rank().over(Window.partitionBy("feature").orderBy(F.desc("ts")))
    rows = ics.withColumn("_k", place)
    windows = list(windows)
    out = rows.groupBy("feature").agg(*[F.avg(F.when(F.col("_k") <= w, F.col("ic"))).alias(f"ic_{w}") for w in windows])
    change = F.col(f"ic_{windows[0]}") - F.col(f"ic_{windows[1]}")
    return out.withColumn("trend", F.when(change > 0.01, "improving").when(change < -0.01, "declining").otherwise("stable"))


def feature_health(rows: DataFrame, features: list[str], target: str) -> DataFrame:
    """Mean IC and t of each feature with the largest absolute correlation to another one, and a class."""
    ics = ic_summary(daily_ic(rows, features, target))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    corrs = rows.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = corrs.select(F.inline(F.array(*[F.struct(F.lit(x).alias("feature"), F.lit(y).alias("peer"), F.abs(F.col(f"`{a}|{b}`")).alias("r")) for a, b in pairs for x, y in ((a, b), (b, a))])))
    best = long.groupBy("feature").agg(F.max_by("peer", F.struct("r", "peer")).alias("peer"), F.max("r").alias("peer_corr"))
    out = ics.join(best, "feature")
    kind = F.when((F.col("peer_corr") > 0.9) & (F.abs("t_stat") < 2), "candidate_remove").when(F.abs("t_stat") >= 3, "strong").when(F.abs("t_stat") >= 2, "useful").otherwise("weak")
    return out.select("feature", "n_dates", "mean_ic", "t_stat", "peer", "peer_corr", kind.alias("health"))


def decile_spread(rows: DataFrame, score: str, target: str, by: str = "ts", share: float = 0.1) -> DataFrame:
    """Per date the mean target of the top less that of the bottom share."""
    w = Window.partitionBy(by)
    day = rows.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    day = day.withColumns({"_t": F.row_number().over(w.orderBy(F.desc(score), "symbol")), "_l": F.row_number().over(w.orderBy(F.asc(score), "symbol")), "_n": F.greatest(F.floor(F.count(F.lit(1)).over(w) * share), F.lit(1))})
    out = day.groupBy(by).agg(F.avg(F.when(F.col("_t") <= F.col("_n"), F.col(target))).alias("top"), F.avg(F.when(F.col("_l") <= F.col("_n"), F.col(target))).alias("bottom"))
    return out.withColumn("spread", F.col("top") - F.col("bottom"))


def topk_overlap(rows: DataFrame, a: str, b: str, k: int, by: str = "ts") -> DataFrame:
    """Per date the Jaccard overlap of the ``k`` best by two scores."""
    w = Window.partitionBy(by)
    day = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    day = day.withColumns({"_a": F.row_number().over(w.orderBy(F.desc(a), "symbol")) <= k, "_b": F.row_number().over(w.orderBy(F.desc(b), "symbol")) <= k})
    return day.groupBy(by).agg((F.count_if(F.col("_a") & F.col("_b")) / F.count_if(F.col("_a") | F.col("_b"))).alias("overlap"))


def calibration_table(rows: DataFrame, keys: dict[str, Column], ret: str) -> DataFrame:
    """Hit rate and mean by every key of every type, from one pass over the rows."""
    items = F.array(*[F.struct(F.lit(n).alias("bucket_type"), c.cast("string").alias("bucket")) for n, c in keys.items()])
    long = rows.where(F.col(ret).isNotNull()).select(F.col(ret).alias("_r"), F.inline(items)).where("bucket is not null")
    out = long.groupBy("bucket_type", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_r") > 0).cast("int")).alias("hit_rate"), F.avg("_r").alias("mean"))
    return out.withColumn("status", F.when(F.col("n") < 30, "insufficient").when(F.col("hit_rate") >= 0.55, "positive").when(F.col("hit_rate") <= 0.45, "negative").otherwise("neutral"))


def event_lift(rows: DataFrame, flags: list[str], label: str = "label", lag_bars: int = 1) -> DataFrame:
    """How often each flag (of the bar before) is set on rises and drops, against all bars; 2x2 chi-square of rise and drop."""
    shifted = rows.withColumns({f"_f_{f}": lag(F.col(f).cast("int"), lag_bars) for f in flags})
    items = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f"_f_{f}").alias("on")) for f in flags])
    long = shifted.select(F.col(label).alias("_l"), F.inline(items)).where("on is not null")
    out = long.groupBy("flag").agg(
        F.count(F.lit(1)).alias("n"), F.avg("on").alias("base"), *[F.count_if((F.col("_l") == k) & (F.col("on") == v)).alias(f"{k}_{v}") for k in ("rise", "drop") for v in (1, 0)]
    )
    a, b, c, d = (F.col(x).cast("double") for x in ("rise_1", "rise_0", "drop_1", "drop_0"))
    total, product = a + b + c + d, (a + b) * (c + d) * (a + c) * (b + d)
    chi = F.when(product > 0, total * (a * d - b * c) * (a * d - b * c) / product)
    return out.select("flag", "n", "base", (a / (a + b)).alias("rise_rate"), (c / (c + d)).alias("drop_rate"), (a / (a + b) / F.col("base")).alias("rise_lift"), chi.alias("chi2"), normal_tail(F.sqrt(chi)).alias("p_value"))


def event_shift(rows: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """Mann-Whitney U and Cliff's delta of rises against drops, from counts by distinct value.

    Values are first counted; the running sum over a feature's distinct values is
    taken by ranges of them.
    """
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features])
    long = rows.where(F.col(label).isin("rise", "drop")).select(F.col(label).alias("_l"), F.inline(items)).where("x is not null")
    cells = long.groupBy("feature", "x").agg(F.count_if(F.col("_l") == "rise").alias("r"), F.count_if(F.col("_l") == "drop").alias("d"))
    cells = sum_before(cells, ["feature"], "x", "d").withColumn("_won", F.col("r") * (F.col("_below") + F.col("d") / 2))
    out = cells.groupBy("feature").agg(F.sum("r").alias("n_rise"), F.sum("d").alias("n_drop"), F.sum("_won").alias("u"))
    delta = 2 * F.col("u") / (F.col("n_rise") * F.col("n_drop")) - 1
    return out.withColumns({"cliffs_delta": delta, "me": (1 + delta) / F.nullif(1 - delta, F.lit(0.0))})


def combo_walkforward(trades: DataFrame, key: str, days: int = 60, ret: str = "ret", least: int = 5) -> DataFrame:
    """Each month: combinations with an edge over the trailing days, tested on that month's trades.

    A trade counts for the months that begin within ``days`` after it, two or three
    rows, so the trailing windows are an equal key and no range join.
    """
    ahead = F.explode(F.sequence(F.add_months(F.trunc("ts", "month"), 1), F.add_months(F.trunc("ts", "month"), days // 28 + 2), F.expr("interval 1 month")))
    past = trades.withColumn("_m", ahead).where(F.datediff("_m", "ts") <= days)
    scored = past.groupBy("_m", key).agg(F.count(F.lit(1)).alias("_n"), F.avg(ret).alias("_e")).where((F.col("_n") >= least) & (F.col("_e") > 0)).select("_m", key)
    now = trades.withColumn("_m", F.trunc("ts", "month")).join(scored.withColumn("picked", F.lit(True)), ["_m", key], "left")
    return now.groupBy(F.col("_m").alias("month")).agg(F.count(F.lit(1)).alias("n_all"), F.avg(ret).alias("mean_all"), F.count_if(F.col("picked")).alias("n_picked"), F.avg(F.when(F.col("picked"), F.col(ret))).alias("mean_picked"))


def listing_event(listings: DataFrame, bars: DataFrame, windows: Iterable[int] = (5, 21)) -> DataFrame:
    """After a listing (``symbol, listed``): day-1 return, ranges of the first bars, peak, bars until a close at or below the first open."""
    rows = bars.join(listings.select("symbol", "listed"), "symbol").where(F.col("ts") >= F.col("listed"))
    rows = rows.withColumn("idx", F.row_number().over(by_symbol()))
    first = F.max(F.when(F.col("idx") == 1, F.col("open"))).over(Window.partitionBy("symbol"))
    rows = rows.withColumn("first_open", first).where("idx <= 252")
    windows = list(windows)
    out = rows.groupBy("symbol", "listed").agg(
        F.max(F.when(F.col("idx") == 1, (F.col("close") / F.col("open") - 1) * 100)).alias("day1_pct"),
        *[((F.max(F.when(F.col("idx") <= w, F.col("high"))) / F.min(F.when(F.col("idx") <= w, F.col("low"))) - 1) * 100).alias(f"range_{w}") for w in windows],
        ((F.max("high") / F.max("first_open") - 1) * 100).alias("peak_pct"),
        F.max_by("idx", F.struct("high", -F.col("idx"))).alias("peak_bar"),
        F.min(F.when(F.col("close") <= F.col("first_open"), F.col("idx"))).alias("bars_to_open"),
    )
    return out


def entry_offset_returns(listings: DataFrame, bars: DataFrame, offsets: Iterable[int] = (0, 5, 10, 20), hold: int = 30) -> DataFrame:
    """Return over a fixed holding time when entering some bars after a listing: mean, median, win rate."""
    rows = bars.join(listings.select("symbol", "listed"), "symbol").where(F.col("ts") >= F.col("listed"))
    rows = rows.withColumns({"idx": F.row_number().over(by_symbol()) - 1, "_later": F.lead("close", hold).over(by_symbol())})
    rows = rows.where(F.col("idx").isin(*offsets) & F.col("_later").isNotNull()).withColumn("_r", (F.col("_later") / F.col("close") - 1) * 100)
    return rows.groupBy(F.col("idx").alias("offset")).agg(F.count(F.lit(1)).alias("n"), F.avg("_r").alias("mean"), F.percentile("_r", F.lit(0.5)).alias("median"), (100.0 * F.avg((F.col("_r") > 0).cast("int"))).alias("win_pct"))


def setups(bars: DataFrame) -> DataFrame:
    """Named set-ups on session bars that carry VWAP and opening-range columns: ``name, direction`` in long form."""
    mean = full(10, F.avg("volume"), frame(10, -1))
    body = F.col("close") - F.col("open")
    rules = {
        ("opening_range_break", "long"): F.col("break_up"),
        ("opening_range_break", "short"): F.col("break_down"),
        ("vwap_reclaim", "long"): F.col("cross_up"),
        ("vwap_reject", "short"): F.col("cross_down"),
        ("inside_bar", "none"): (F.col("high") < lag("high")) & (F.col("low") > lag("low")),
        ("high_volume_reversal", "long"): (F.col("volume") > 1.5 * mean) & (lag("close") < lag("open")) & (body > 0),
        ("high_volume_reversal", "short"): (F.col("volume") > 1.5 * mean) & (lag("close") > lag("open")) & (body < 0),
        ("higher_low", "long"): (F.col("low") > lag("low")) & (lag("low") > lag("low", 2)),
        ("lower_high", "short"): (F.col("high") < lag("high")) & (lag("high") < lag("high", 2)),
    }
    rows = bars.withColumns({f"_s{i}": F.coalesce(c, F.lit(False)) for i, c in enumerate(rules.values())})
    items = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(d).alias("direction"), F.col(f"_s{i}").alias("on")) for i, (n, d) in enumerate(rules)])
    return rows.select("symbol", "ts", F.inline(items)).where("on").drop("on")


def ablation(rows: DataFrame, components: dict[str, float], target: str) -> DataFrame:
    """Hit rate of the weighted vote with each component left out, and with none left out."""
    left_out = ["none", *components]
    votes = [F.signum(sum((F.lit(w) * F.col(c) for c, w in components.items() if c != x), F.lit(0.0))) for x in left_out]
    items = F.array(*[F.struct(F.lit(x).alias("without"), v.alias("vote")) for x, v in zip(left_out, votes, strict=True)])
    long = rows.where(F.col(target).isNotNull()).select(F.col(target).alias("_y"), F.inline(items)).where("vote <> 0")
    return long.groupBy("without").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_y") * F.col("vote") > 0).cast("int")).alias("hit_rate"), F.avg(F.col("_y") * F.col("vote")).alias("expectancy"))
