"""Window frames over a symbol's bars, with the rule that a value needs its full frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY, TIME = "symbol", "ts"


def by_symbol() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(TIME)


def frame(n: int, end: int = 0) -> WindowSpec:
    """The ``n`` bars up to ``end`` bars from here (0: this bar, -1: the previous one)."""
    return by_symbol().rowsBetween(end - n + 1, end)


def ahead(first: int, last: int) -> WindowSpec:
    return by_symbol().rowsBetween(first, last)


def full(n: int, value: Column, over: WindowSpec) -> Column:
    """``value`` over the frame, or null where the frame has fewer than ``n`` bars."""
    return F.when(F.count(F.lit(1)).over(over) == n, value.over(over))


def lag(c: Column | str, n: int = 1) -> Column:
    return F.lag(c, n).over(by_symbol())


def lead(c: Column | str, n: int = 1) -> Column:
    return F.lead(c, n).over(by_symbol())


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded at the very end; adding 0.0 turns -0.0 into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def sum_before(cells: DataFrame, by: list[str], value: str, count: str, parts: int = 64) -> DataFrame:
    """Add ``_below``: the sum of ``count`` over the rows of the group with a smaller ``value``; values are distinct.

    A group is divided at approximate quantiles into ranges of values. The sum runs
    inside each range and over the few ranges, so that no task orders a whole group.
    """
    edges = cells.groupBy(*by).agg(F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(10_000)).alias("_edges"))
    rows = cells.join(edges, by).withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")
    sums = rows.groupBy(*by, "_part").agg(F.sum(count).alias("_m"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_part", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, [*by, "_part"])
    return rows.withColumn("_below", F.col("_base") + F.coalesce(F.sum(count).over(inside), F.lit(0))).drop("_part", "_base")
