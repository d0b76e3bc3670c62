"""Nearest neighbours of vectors under gates, and what followed the neighbours."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window


def distance(a: Column, b: Column, weights: list[float] | None = None) -> Column:
    """Weighted Euclidean distance of two arrays."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    if weights is not None:
        square = F.zip_with(square, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w)
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def _best(met: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("distance").asc_nulls_last(), "neighbor"))
    return met.withColumn("rank", place).where(F.col("rank") <= k)


#: Rows of a gate that one task searches at once, and queries that it holds beside them.
PART_ROWS, PART_QUERIES = 32_768, 8_192
#: Distances held at once.
_HELD = 1 << 22
#: Components beyond this are compared one by one: their squares may overflow.
_LARGE = 1e150


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows (padded with NaN), which of them have no distance (null, or with a null component), and their sizes."""
    lists = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    flat = pc.list_flatten(lists)
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.full((len(sizes), max(1, int(sizes.max(initial=0)))), np.nan)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    unknown = lists.is_null().to_numpy(zero_copy_only=False)
    unknown[row[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    return out, unknown, sizes


def _distances(q: np.ndarray, m: np.ndarray, weights: list[float] | None) -> np.ndarray:
    """Distances of rows of equal number, summed in the order of :func:`distance`."""
    total = np.zeros(len(q))
    with np.errstate(all="ignore"):
        for j in range(q.shape[1]):
            square = (q[:, j] - m[:, j]) * (q[:, j] - m[:, j])
            total = total + (square if weights is None else square * weights[j])
        return np.sqrt(total)


def _nearest(q: np.ndarray, m: np.ndarray, plain: np.ndarray, k: int, weights: list[float] | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) among which are the ``k`` nearest of every query, by products of matrices and a margin for their rounding."""
    w = np.ones(q.shape[1]) if weights is None else np.array(weights)
    rows = np.flatnonzero(plain)
    if len(rows) <= k:
        found = np.arange(len(q)).repeat(len(rows)), np.tile(rows, len(q))
    else:
        m = m[rows]
        qq, mm = (q * q) @ np.abs(w), (m * m) @ np.abs(w)
        square = (q * w) @ m.T
        square *= -2
        square += mm + qq[:, None]
        bound = np.partition(square, k - 1, axis=1)[:, k - 1] + 1e-10 * (qq + mm.max())
        at, col = np.nonzero(square <= bound[:, None])
        found = at, rows[col]
    odd = np.flatnonzero(~plain)
    return np.concatenate([found[0], np.arange(len(q)).repeat(len(odd))]), np.concatenate([found[1], np.tile(odd, len(q))])


def _searched(k: int, weights: list[float] | None, names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Search of one part of a gate by some of its queries: the ``k`` nearest in the part for each."""

    def search(queries: pa.Table, memory: pa.Table) -> pa.Table:
        memory = memory.sort_by("neighbor")
        q_ids, m_ids = queries["query"], memory["neighbor"]
        if not len(q_ids) or not len(m_ids):
            return pa.table([q_ids.slice(0, 0), m_ids.slice(0, 0), pa.array([], pa.float64())], names=names)
        (q, q_unknown, q_size), (m, m_unknown, m_size) = _vectors(queries["_q"]), _vectors(memory["_m"])
        width = max(q.shape[1], m.shape[1], len(weights or []))
        factors = None if weights is None else [*weights, *[np.nan] * (width - len(weights))]
        q, m = (np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=np.nan) for x in (q, m))
        # Of equal vectors only those of the least ids can be among the nearest; one of them may be the query.
        _, kind = np.unique(m.view(np.int64), axis=0, return_inverse=True)
        kind = 2 * kind.reshape(-1) + m_unknown
        order = np.lexsort((np.arange(len(m)), kind))
        starts = np.flatnonzero(np.concatenate([[True], kind[order][1:] != kind[order][:-1]]))
        nth = np.arange(len(m)) - np.repeat(starts, np.diff(np.append(starts, len(m))))
        kept = np.sort(order[nth <= k])
        m, m_unknown, m_size, m_ids = m[kept], m_unknown[kept], m_size[kept], m_ids.take(pa.array(kept))
        simple = lambda x, size: (size == width) & (np.abs(np.nan_to_num(x, nan=np.inf)) < _LARGE).all(axis=1)
        q_plain, plain = simple(q, q_size), simple(m, m_size)
        out = []
        step = max(1, _HELD // len(m))
        positive = factors is None or min(factors) >= 0
        for ready in (True, False):
            chosen = np.flatnonzero(q_plain if ready else ~q_plain)
            for low in range(0, len(chosen), step):
                part = chosen[low : low + step]
                # The query itself may be among them.
                at, row = _nearest(q[part], m, plain if ready and positive else np.zeros(len(m), bool), k + 1, factors)
                at = part[at]
                apart = pc.not_equal(q_ids.take(pa.array(at)), m_ids.take(pa.array(row))).to_numpy(zero_copy_only=False)
                at, row = at[apart], row[apart]
                d = np.concatenate([np.empty(0), *[_distances(q[at[i : i + _HELD // 64]], m[row[i : i + _HELD // 64]], factors) for i in range(0, len(at), _HELD // 64)]])
                unknown = q_unknown[at] | m_unknown[row] | (q_size[at] != m_size[row]) | (q_size[at] != (q_size[at] if weights is None else len(weights)))
                order = np.lexsort((row, np.where(unknown, 0.0, d), unknown, at))
                at, row, d, unknown = at[order], row[order], d[order], unknown[order]
                new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])[: len(at)])
                best = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at)))) < k
                out.append(pa.table([q_ids.take(pa.array(at[best])), m_ids.take(pa.array(row[best])), pa.array(d[best], mask=unknown[best])], names=names))
        return pa.concat_tables(out)

    return search


def knn_join(queries: DataFrame, memory: DataFrame, k: int, gates: list[str], vector: str = "embedding", key: str = "vec_id", weights: list[float] | None = None, cells: int = 16) -> DataFrame:
    """The ``k`` nearest rows of ``memory`` that share a query's gates, itself excluded; exact.

    The rows of a gate are dealt by hash to ``cells`` parts, or to more of at most
    about ``PART_ROWS`` rows, its queries to sets of about ``PART_QUERIES``. Each part
    is searched by each set, as blocks of matrices, and gives its ``k`` nearest of
    every query, with distances in double precision; the nearest of all parts
    remain. Vectors without a distance (null, with a null component, of another
    size) come last. All pairs of a gate are compared: the work grows with the
    square of a gate, a task's memory does not grow.
    """
    # Named anew on either side: both may come from one table.
    as_gates = lambda: [F.col(g).alias(f"_g{i}") for i, g in enumerate(gates)]
    q = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("query"), F.col(vector).alias("_q"), *as_gates())
    m = memory.where(F.col(key).isNotNull()).select(F.col(key).alias("neighbor"), F.col(vector).alias("_m"), *as_gates())
    gates = [f"_g{i}" for i in range(len(gates))]
    parts = m.groupBy(*gates).agg(F.greatest(F.lit(cells), F.ceil(F.count(F.lit(1)) / PART_ROWS)).cast("int").alias("_parts"))
    sets = q.groupBy(*gates).agg(F.ceil(F.count(F.lit(1)) / PART_QUERIES).cast("int").alias("_sets"))
    plan = parts.join(sets, gates)
    dealt = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(plan, gates).withColumn("_set", dealt("query", F.col("_sets"))).withColumn("_part", every("_parts")).drop("_parts", "_sets")
    m = m.join(plan, gates).withColumn("_part", dealt("neighbor", F.col("_parts"))).withColumn("_set", every("_sets")).drop("_parts", "_sets")
    by = [*gates, "_part", "_set"]
    schema = StructType([StructField("query", q.schema["query"].dataType), StructField("neighbor", m.schema["neighbor"].dataType), StructField("distance", DoubleType())])
    met = q.groupBy(*by).cogroup(m.groupBy(*by)).applyInArrow(_searched(k, weights, schema.names), schema)
    return _best(met, k).select("query", "rank", "neighbor", "distance")


def neighbor_outcomes(matches: DataFrame, outcomes: DataFrame, key: str, value: str, least: int = 3) -> DataFrame:
    """Per query with enough neighbours: count, mean, median, hit rate and deviation of their outcomes."""
    rows = matches.join(outcomes.select(F.col(key).alias("neighbor"), F.col(value).alias("_y")), "neighbor").where("_y is not null")
    out = rows.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"), F.percentile("_y", F.lit(0.5)).alias("median"), F.avg((F.col("_y") > 0).cast("int")).alias("hit_rate"), F.stddev_samp("_y").alias("std"))
    return out.where(F.col("n") >= least)
