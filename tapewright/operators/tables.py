"""Table upkeep: keyed updates, newest rows, wide and long forms, validation, keys of buckets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import frame, full, lag


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], keep_old_when_null: Iterable[str] = ()) -> DataFrame:
    """The target after inserts and updates by key; some columns keep the old value where the new is null."""
    old, new = target.alias("o"), updates.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    both = old.withColumn("_o", F.lit(True)).alias("o").join(new.withColumn("_n", F.lit(True)).alias("n"), on, "full_outer")

    def pick(c: str) -> Column:
        if c in keys or c in set(keep_old_when_null):
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
        return F.when(F.col("n._n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(*[pick(c) for c in target.columns])


def append_new(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """The target and those updates whose key it doesn't have."""
    return target.unionByName(updates.join(target.select(*keys).distinct(), keys, "left_anti").select(*target.columns))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by an aggregate that combines before the shuffle."""
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return out.select("_r.*")


def pivot_features(long: DataFrame, names: list[str], keys: Iterable[str] = ("symbol", "ts")) -> DataFrame:
    """Long to wide with a fixed list of columns; what is missing is null."""
    return long.groupBy(*keys).pivot("feature_name", names).agg(F.first("feature_value"))


def unpivot_features(wide: DataFrame, names: list[str], keys: Iterable[str] = ("symbol", "ts")) -> DataFrame:
    return wide.unpivot(list(keys), names, "feature_name", "feature_value").where("feature_value is not null")


def infer_listings(bars: DataFrame, since: str) -> DataFrame:
    """Symbols whose first bar is after a date, with the day's pop and its class."""
    first = bars.groupBy("symbol").agg(F.min_by(F.struct("ts", "open", "close"), "ts").alias("f")).select("symbol", "f.*").where(F.col("ts") > F.lit(since).cast("date"))
    pop = (F.col("close") / F.col("open") - 1) * 100
    kind = F.when(pop >= 30, "hot").when(pop >= 10, "warm").when(pop >= 0, "cold").otherwise("broken")
    return first.select("symbol", F.col("ts").alias("listed"), pop.alias("pop_pct"), kind.alias("pop_class"))


def bucketize(column: Column, edges: list[float], labels: list[str], missing: str | None = None) -> Column:
    """Half-open buckets: below the first edge, between edges, at or above the last."""
    out = F.when(column < edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:-1], strict=True):
        out = out.when(column < edge, label)
    out = out.when(column >= edges[-1], labels[-1])
    return out if missing is None else out.otherwise(missing)


def combo_key(parts: dict[str, Column]) -> Column:
    """``name=value|name=value`` with ``unk`` for nulls."""
    return F.concat_ws("|", *[F.concat(F.lit(f"{n}="), F.coalesce(c.cast("string"), F.lit("unk"))) for n, c in parts.items()])


def parse_combo_key(key: Column, names: Iterable[str]) -> dict[str, Column]:
    pairs = F.str_to_map(key, F.lit("\\|"), F.lit("="))
    return {n: F.nullif(pairs[n], F.lit("unk")) for n in names}


#: Warnings and what each takes from the score (fixed values).
WEIGHTS = {"nan_prices_low": 0.05, "date_gap": 0.10, "volume_outlier": 0.15, "adjustment_anomaly": 0.20, "future_date": 0.05}
#: Findings that end the validation, in the order in which they are looked for (fixed values).
FATAL = ("insufficient_bars", "nan_prices_high", "nonpositive_price", "duplicate_dates", "flat_prices")


def validate_bars(bars: DataFrame, as_of: str, least: int = 15, most_gap: int = 5, outlier: float = 20.0, flat: int = 10, null_pct: float = 2.0) -> DataFrame:
    """Per symbol: ``symbol, n, ok, score, fatal, flags``.

    ``fatal`` is the first of ``FATAL`` that holds: fewer bars than ``least``,
    ``null_pct`` percent null adjusted closes or more, one at or below zero, a
    repeated date, the last ``flat`` known ones alike. Without one, ``flags`` has the
    warnings, and each takes its weight from a score of 1: fewer nulls, a gap of
    more than ``most_gap`` days, a last bar after ``as_of``, a last known volume over
    ``outlier`` times the mean of the 20 before, an adjusted close over three times
    the raw one. A fatal symbol has score 0.
    """
    known = lambda c: Window.partitionBy("symbol", F.col(c).isNull()).orderBy(F.desc("ts"))
    rows = bars.withColumns({"_gap": F.datediff("ts", lag("ts")), "_price": F.row_number().over(known("adjusted_close")), "_size": F.row_number().over(known("volume"))})
    last_prices = F.when(F.col("adjusted_close").isNotNull() & (F.col("_price") <= flat), F.col("adjusted_close"))
    size = lambda rule: F.when(F.col("volume").isNotNull() & rule, F.col("volume"))
    out = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("adjusted_close").isNull()).alias("nulls"),
        F.min("adjusted_close").alias("lowest"),
        F.countDistinct("ts").alias("dates"),
        F.countDistinct(last_prices).alias("last_prices"),
        F.max("_gap").alias("gap"),
        F.max("ts").alias("last"),
        F.max(size(F.col("_size") == 1)).alias("size"),
        F.avg(size(F.col("_size").between(2, 21))).alias("mean_size"),
        F.count("volume").alias("sizes"),
        F.max(F.when(F.col("close") > 0, F.col("adjusted_close") / F.col("close"))).alias("ratio"),
    )
    share = 100.0 * F.col("nulls") / F.col("n")
    fatal = F.when(F.col("n") < least, FATAL[0]).when(share >= null_pct, FATAL[1]).when(F.col("lowest") <= 0, FATAL[2]).when(F.col("dates") < F.col("n"), FATAL[3])
    fatal = fatal.when((F.col("n") - F.col("nulls") >= flat) & (F.col("last_prices") == 1), FATAL[4]).otherwise("")
    spike = (F.col("sizes") >= 21) & (F.col("mean_size") > 0) & (F.col("size") > outlier * F.col("mean_size"))
    rules = {"nan_prices_low": F.col("nulls") > 0, "date_gap": F.col("gap") > most_gap, "volume_outlier": spike, "adjustment_anomaly": F.col("ratio") > 3, "future_date": F.col("last") > F.lit(as_of).cast("date")}
    flags = F.concat_ws("|", *[F.when(F.coalesce(rules[n], F.lit(False)), F.lit(n)) for n in WEIGHTS])
    lost = sum((F.when(F.coalesce(rules[n], F.lit(False)), w).otherwise(0.0) for n, w in WEIGHTS.items()), F.lit(0.0))
    ok = fatal == ""
    return out.select("symbol", "n", ok.alias("ok"), F.when(ok, F.greatest(1 - lost, F.lit(0.0))).otherwise(0.0).alias("score"), fatal.alias("fatal"), F.when(ok, flags).otherwise("").alias("flags"))


def validation_summary(found: DataFrame) -> DataFrame:
    warned = F.col("ok") & (F.col("flags") != "")
    return found.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ok") & (F.col("flags") == "")).alias("clean"), F.count_if(warned).alias("warned"),
        F.count_if(~F.col("ok")).alias("fatal"), (100.0 * F.count_if(~F.col("ok")) / F.count(F.lit(1))).alias("failure_pct"),
    )


#: Tier, bounds of the median close, and mean turnover that is exceeded (fixed values).
TIERS = ((1, 50, None, 25_000_000), (2, 20, 50, 5_000_000), (3, 5, 20, 1_000_000))


def quality_tier(bars: DataFrame) -> DataFrame:
    """Tier 1 to 4 per symbol from median close and mean turnover of its last 252 bars."""
    last = bars.withColumn("_back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where("_back <= 252")
    out = last.groupBy("symbol").agg(F.percentile("close", F.lit(0.5)).alias("median_close"), F.avg(F.col("close") * F.col("volume")).alias("turnover"))
    tier = F.lit(4)
    for number, low, high, least in reversed(TIERS):
        within = F.col("median_close") > low if high is None else F.col("median_close").between(low, high)
        tier = F.when(within & (F.col("turnover") > least), number).otherwise(tier)
    return out.withColumn("tier", tier)


def profile_matrix(rows: DataFrame, features: list[str], by: str = "ts") -> DataFrame:
    """Per date the number of rows and each feature's share of nulls, in long form."""
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), *[(100.0 * F.count_if(F.col(f).isNull()) / F.count(F.lit(1))).alias(f) for f in features])
    return out.unpivot([by, "n_rows"], features, "feature", "null_pct")


def resolve_universe(rows: DataFrame, spec: str) -> DataFrame:
    """One symbol if the table has it, else all of them."""
    symbols = rows.select("symbol").distinct()
    if len(spec) <= 8 and not symbols.where(F.col("symbol") == spec).isEmpty():
        return symbols.where(F.col("symbol") == spec)
    return symbols


def asof_join(left: DataFrame, right: DataFrame, value: str, by: str = "symbol", at: str = "ts", strictly: bool = True) -> DataFrame:
    """For each left row the latest right value before it, by one union and one window per key."""
    order = F.lit(1 if strictly else 0)
    rows = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_o": F.lit(0) if strictly else F.lit(1), "_left": F.lit(True)})
    other = right.select(F.col(by), F.col(at), F.col(value).alias("_v"), order.alias("_o"), F.lit(False).alias("_left"))
    both = rows.unionByName(other, allowMissingColumns=True)
    over = Window.partitionBy(by).orderBy(at, "_o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(over)).where("_left").drop("_v", "_o", "_left")


