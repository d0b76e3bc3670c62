"""Hard negatives: blocks of candidates in the order of a Hilbert curve, chosen by bounds on their scores.

Rows are sorted by label and by their place on a Hilbert curve and written as blocks, Parquet
rows of up to 256 vectors of one label, each with the least and the greatest value
of every dimension. From these, interval arithmetic bounds the inner products that
an anchor can have with a block's vectors. A window of scores is searched in two
waves: first the most promising block of every page of blocks, which shows
how high the first few hits are; then all other blocks whose bounds meet what is
left of the window. A block that is left out can hold no hit.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .caps import usable_components
from .scratch import discard, materialize

#: Vectors of a block, anchors of a tile, and blocks whose bounds are looked at together.
BLOCK, TILE, PAGE = 256, 128, 256
#: Bits of each dimension in a place on the curve: quarters of a normal distribution.
BITS = 2
_QUARTERS = (-0.6745, 0.0, 0.6745)
#: Tiles whose first hits a worker remembers, so that it need not send what they beat.
_REMEMBERED = 64
_ALL = 2**63 - 1


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of every row of coordinates below ``2**bits``: bytes, in ascending order along the curve.

    Skilling's method: the coordinates are turned, one bit plane after the other, into
    the bits of the place.
    """
    x = cells.astype(np.int64).T.copy()
    for plane in range(bits - 1, 0, -1):
        below = (1 << plane) - 1
        for i in range(len(x)):
            high = (x[i] >> plane) & 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    last = np.zeros(x.shape[1], np.int64)
    for plane in range(bits - 1, 0, -1):
        last ^= np.where((x[-1] >> plane) & 1, (1 << plane) - 1, 0)
    x ^= last
    planes = np.concatenate([(x >> plane) & 1 for plane in range(bits - 1, -1, -1)])
    return np.packbits(planes.astype(np.uint8), axis=0).T


def _bytes(matrix: np.ndarray) -> bytes:
    """The values as 32-bit floats where those hold them exactly."""
    short = matrix.astype(np.float32)
    return short.tobytes() if np.array_equal(short, matrix) else matrix.astype(np.float64).tobytes()


def _values(data: bytes, dims: int, rows: int) -> np.ndarray:
    kind = np.float32 if len(data) == 4 * dims * rows else np.float64
    return np.frombuffer(data, kind).reshape(rows, dims).astype(np.float64)


def _dense(lists: pa.Array, dims: int) -> np.ndarray:
    out = np.zeros((len(lists), dims))
    out[np.arange(dims) < np.diff(np.asarray(lists.offsets))[:, None]] = np.asarray(lists.flatten())
    return out


def _moments(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _dense(batch.column(0), dims)
            columns = [np.arange(dims), np.full(dims, len(x)), x.sum(axis=0), (x * x).sum(axis=0)]
            yield pa.record_batch([pa.array(c) for c in columns], names=["dim", "n", "s", "ss"])

    return run


def _keyed(dims: int, mean: np.ndarray, deviation: np.ndarray):
    edges = mean + np.array(_QUARTERS)[:, None] * deviation

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _dense(batch.column(3), dims)
            cells = sum((x >= edge).astype(np.int64) for edge in edges)
            keys = [k.tobytes() for k in hilbert_keys(cells)]
            vectors = [_bytes(row[None, :]) for row in x]
            yield pa.record_batch([*batch.columns[:3], pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], names=["place", "id", "label", "key", "vector"])

    return run


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows in runs of one label and of at most ``size``."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        codes = np.asarray(batch.column("label").dictionary_encode().indices)
        start, ends = 0, [*(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(batch)]
        for end in ends:
            while end - start > size or (end - start and end < len(batch)):
                yield batch.slice(start, min(size, end - start))
                start = min(start + size, end)
        rest = batch.slice(start)
    if rest is not None and len(rest):
        yield rest


def _number(i: int) -> int:
    return (TaskContext.get().partitionId() << 40) + i


def _blocks(dims: int):
    names = ["block", "label", "n", "places", "ids", "vectors", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, part in enumerate(_cut(batches, BLOCK)):
            x = np.concatenate([_values(v, dims, 1) for v in part.column("vector").to_pylist()])
            places, ids = [np.asarray(part.column(c), np.int64).tobytes() for c in ("place", "id")]
            row = [_number(i), part.column("label")[0].as_py(), len(x), places, ids, _bytes(x), _bytes(x.min(axis=0)[None, :]), _bytes(x.max(axis=0)[None, :])]
            yield pa.record_batch([pa.array([v]) for v in row], names=names)

    return run


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for i, part in enumerate(_cut(batches, TILE)):
        tile = pa.array(np.full(len(part), _number(i)))
        yield pa.record_batch([tile, *[part.column(c) for c in ("place", "id", "label", "vector")]], names=["tile", "place", "id", "label", "vector"])


def _pages(dims: int):
    names = ["page", "blocks", "labels", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            for start in range(0, len(batch), PAGE):
                part = batch.slice(start, PAGE)
                low, high = [_bytes(np.concatenate([_values(v, dims, 1) for v in part.column(c).to_pylist()])) for c in (2, 3)]
                row = [_number(done), np.asarray(part.column(0)).tobytes(), part.column(1).to_pylist(), low, high]
                done += 1
                yield pa.record_batch([pa.array([v]) for v in row], names=names)

    return run


class _Anchors:
    """A tile: its anchors' vectors and windows of scores, ``m`` anchors by ``w`` windows, and the least score still of use."""

    def __init__(self, row: dict, dims: int):
        anchors = sorted(row["anchors"], key=lambda a: a["place"])
        self.label = row["label"]
        self.places = np.array([a["place"] for a in anchors], np.int64)
        self.vectors = np.concatenate([_values(a["vector"], dims, 1) for a in anchors])
        most = max(len(a["windows"]) for a in anchors)
        shape = len(anchors), most
        self.number = np.zeros(shape, np.int64)
        self.low, self.high = np.full(shape, _ALL), np.full(shape, -_ALL)
        for i, a in enumerate(anchors):
            for j, w in enumerate(a["windows"]):
                self.number[i, j], self.low[i, j], self.high[i, j] = w["window"], w["low"], w["high"]


def _choose(dims: int, same: bool, first: bool):
    """Pairs of a tile and a block of a page: the best block (``first``), or every other one whose bounds meet a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles, blocks = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for row in batch.to_pylist():
                t = _Anchors(row, dims)
                names = np.frombuffer(row["blocks"], np.int64)
                low, high = [_values(row[c], dims, len(names)) for c in ("low", "high")]
                fits = np.array([(x == t.label) is same for x in row["labels"]])
                if not fits.any():
                    continue
                up, down = np.maximum(t.vectors, 0), np.minimum(t.vectors, 0)
                least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
                # More than rounding can change.
                slack = np.abs(t.vectors) @ np.maximum(np.abs(low), np.abs(high)).T * 1e-9 + 0.5
                meet = np.zeros(least.shape, bool)
                for w in range(t.low.shape[1]):
                    meet |= (most + slack >= t.low[:, w, None]) & (least - slack <= t.high[:, w, None])
                meet = meet.any(axis=0) & fits
                if meet.any():
                    if first:
                        meet = np.arange(len(meet)) == np.argmax(np.where(meet, most.max(axis=0), -np.inf))
                    elif row["done"] is not None:
                        meet &= names != row["done"]
                names = names[meet]
                tiles.append(np.full(len(names), row["tile"]))
                blocks.append(names)
            yield pa.record_batch([pa.array(np.concatenate(tiles)), pa.array(np.concatenate(blocks))], names=["tile", "block"])

    return run


def _scored(dims: int, k: int):
    """Candidates for the first ``k`` of each window, from pairs of a tile and a block."""
    names = ["place", "window", "score", "candidate"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[int, tuple[_Anchors, np.ndarray, np.ndarray]] = OrderedDict()
        for batch in batches:
            out = [[np.empty(0, np.int64)] for _ in names]
            for row in batch.to_pylist():
                if row["tile"] not in seen:
                    t = _Anchors(row, dims)
                    best = np.full((*t.low.shape, k), -np.inf, np.longdouble)
                    seen[row["tile"]] = t, best, t.low.astype(np.longdouble)
                    if len(seen) > _REMEMBERED:
                        seen.popitem(last=False)
                seen.move_to_end(row["tile"])
                t, best, floor = seen[row["tile"]]
                places, ids = [np.frombuffer(row[c], np.int64) for c in ("places", "ids")]
                vectors = _values(row["vectors"], dims, row["n"])
                bound = (np.abs(t.vectors).max(axis=0) * np.abs(vectors).max(axis=0)).sum()
                if bound >= 2.0**62:
                    raise ValueError("scores don't fit into 64 bits")
                kind = np.float64 if bound < 2.0**53 else np.longdouble
                scores = t.vectors.astype(kind) @ vectors.astype(kind).T
                own = t.places[:, None] == places[None, :]
                for w in range(t.low.shape[1]):
                    r, c = np.nonzero((scores >= floor[:, w, None]) & (scores <= t.high[:, w, None]) & ~own)
                    if not len(r):
                        continue
                    order = np.lexsort((places[c], ids[c], -scores[r, c], r))
                    r, c = r[order], c[order]
                    rank = np.arange(len(r)) - np.searchsorted(r, r)
                    r, c, rank = r[rank < k], c[rank < k], rank[rank < k]
                    new = np.full((len(best), k), -np.inf, np.longdouble)
                    new[r, rank] = scores[r, c]
                    best[:, w] = -np.sort(-np.concatenate([best[:, w], new], axis=1), axis=1)[:, :k]
                    floor[:, w] = np.maximum(floor[:, w], best[:, w, -1])
                    for to, values in zip(out, (t.places[r], t.number[r, w], scores[r, c].astype(np.int64), ids[c]), strict=True):
                        to.append(values)
            yield pa.record_batch([pa.array(np.concatenate(v)) for v in out], names=names)

    return run


def _first(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` hits of each window, with their rank."""
    order = Window.partitionBy("place", "window").orderBy(F.desc("score"), "candidate")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _tiles(anchors: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of tiles: ``tile, label, anchors``; anchors without a window are left out."""
    window = F.struct("window", "low", "high")
    grouped = windows.groupBy("place").agg(F.sort_array(F.collect_list(window)).alias("windows"))
    rows = anchors.join(grouped, "place").groupBy("tile", "label")
    return rows.agg(F.collect_list(F.struct("place", "vector", "windows")).alias("anchors"))


def _search(anchors: DataFrame, windows: DataFrame, blocks: DataFrame, dims: int, k: int, same: bool) -> DataFrame:
    """``place, window, score, candidate, rank``: the first ``k`` rows, of the same label or of others, in each window of scores.

    ``windows`` has ``place, window, low, high``.
    """
    zones = blocks.select("block", "label", "low", "high")
    pages = materialize(zones.mapInArrow(_pages(dims), "page long, blocks binary, labels array<string>, low binary, high binary"), "negatives-pages")
    # Every tile looks at every page's bounds: both are dealt to as many parts as there are pages, up to 64.
    parts = max(1, min(64, pages.count()))
    dealt = pages.withColumn("part", F.pmod(F.xxhash64("page"), F.lit(parts)).cast("int"))

    def pairs(tiles: DataFrame, first: bool, done: DataFrame | None = None) -> DataFrame:
        spread = tiles.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        met = spread.join(dealt, "part").drop("part")
        if done is None:
            met = met.withColumn("done", F.lit(None).cast("long"))
        else:
            met = met.join(done, ["tile", "page"], "left")
        return met.mapInArrow(_choose(dims, same, first), "tile long, block long")

    def read(tiles: DataFrame, chosen: DataFrame) -> DataFrame:
        rows = chosen.join(tiles, "tile").join(blocks.select("block", "n", "places", "ids", "vectors"), "block")
        hits = rows.mapInArrow(_scored(dims, k), "place long, window long, score long, candidate long")
        return _first(hits, k).drop("rank")

    tiles = materialize(_tiles(anchors, windows), "negatives-tiles")
    best = materialize(pairs(tiles, first=True), "negatives-best")
    found = materialize(read(tiles, best), "negatives-found")
    # A window that is full already needs nothing below its last hit.
    full = found.groupBy("place", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last")).where(F.col("n") == k)
    narrowed = windows.join(full, ["place", "window"], "left").select("place", "window", F.greatest("low", "last").alias("low"), "high")
    narrow = materialize(_tiles(anchors, narrowed), "negatives-tiles")
    # At most one block of a page has been read by a tile.
    where = pages.select("page", F.explode(_longs("blocks")).alias("done"))
    done = materialize(best.withColumnRenamed("block", "done").join(where, "done"), "negatives-done")
    chosen = materialize(pairs(narrow, first=False, done=done), "negatives-chosen")
    out = materialize(_first(found.unionByName(read(narrow, chosen)), k), "negatives-hits")
    discard(tiles, narrow, found, done, best, chosen, pages)
    return out


def _longs(column: str) -> Column:
    """The 64-bit numbers that are stored one after the other as bytes."""

    @F.pandas_udf("array<long>")
    def longs(data):
        return data.map(lambda b: np.frombuffer(b, np.int64))

    return longs(column)


def _floored(x: Column) -> Column:
    """The floor as a double; a double beyond 2**52 is an integer already."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _floor_div(a: Column, b: int) -> Column:
    """The floor of ``a / b`` for long integers; their remainders are taken first, so that doubles don't round."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def mine_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    every: int = 100,
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every anchor and positive.

    Components ``x`` become ``floor(scale * x)``; a score is the integer inner
    product. Anchors are the rows whose id is divisible by ``every``. An anchor's
    ``positives`` are the other rows of its label with the highest scores, its
    ``negatives`` for a positive of score ``p`` the rows of other labels with the highest scores
    ``s`` for which ``low * p <= 100 * s <= high * p``. Of equal scores the smaller
    id comes first. All rows are candidates, and results are exact: a block is left out only if its bounds say so.

    Rows with a null id or label, or a vector that is null or has null or non-finite
    components, take no part. Shorter vectors end in zeros. Rows that
    repeat an id are rows of their own; an anchor isn't its own positive, but another row of
    its id may be. Scores beyond 62 bits raise an error. Other columns are not looked at; an empty
    table gives an empty result.
    """
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable_components(F.col("vector")))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: _floored(x * scale)))
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("place"), "id", "label", "vector"), "negatives-rows")
    dims = max(1, rows.agg(F.max(F.size("vector"))).first()[0] or 0)

    # As many sums as there are dimensions.
    sums = rows.select("vector").mapInArrow(_moments(dims), "dim long, n long, s double, ss double").groupBy("dim")
    sums = sorted(sums.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect())
    n, s, ss = np.array([r[1:] for r in sums], float).T if sums else np.array([[1.0], [0.0], [1.0]])
    mean = s / n
    deviation = np.sqrt(np.maximum(ss / n - mean**2, 0))

    kept = "place long, id long, label string, key binary, vector binary"
    placed = materialize(rows.mapInArrow(_keyed(dims, mean, deviation), kept), "negatives-placed")
    in_order = placed.repartitionByRange("label", "key", "place").sortWithinPartitions("label", "key", "place")
    blocks = in_order.mapInArrow(_blocks(dims), "block long, label string, n long, places binary, ids binary, vectors binary, low binary, high binary")
    blocks = materialize(blocks, "negatives-blocks")
    anchors = placed.where(F.col("id") % every == 0).repartitionByRange("label", "key", "place").sortWithinPartitions("label", "key", "place")
    anchors = materialize(anchors.mapInArrow(_tiled, "tile long, place long, id long, label string, vector binary"), "negatives-anchors")
    discard(rows)

    anywhere = anchors.select("place", F.lit(0).cast("long").alias("window"), F.lit(-_ALL).alias("low"), F.lit(_ALL).alias("high"))
    near = _search(anchors, anywhere, blocks, dims, positives, same=True)
    near = near.select("place", F.col("rank").cast("long").alias("window"), F.col("candidate").alias("positive_id"), F.col("score").alias("positive_score"))
    p = F.col("positive_score")
    windows = near.select("place", "window", (-_floor_div(-low * p, 100)).alias("low"), _floor_div(high * p, 100).alias("high")).where("low <= high")
    hard = _search(anchors, windows, blocks, dims, negatives, same=False)
    out = hard.join(near, ["place", "window"]).join(anchors.select("place", F.col("id").alias("anchor_id")), "place")
    return out.select("anchor_id", "positive_id", "rank", F.col("candidate").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """Rows whose id is divisible by 7 with the next of ten labels."""
    moved = F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col))
    return vectors.withColumn(label_col, moved)


def oracle() -> str:
    """The same in DuckDB's SQL: every anchor against every row."""
    return """
        WITH scaled AS MATERIALIZED (
            SELECT row_number() OVER () AS place, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS MATERIALIZED (
            SELECT a.place, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM scaled a JOIN scaled b ON a.place <> b.place WHERE a.vec_id % 100 = 0),
        positives AS (
            SELECT place, anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY place ORDER BY score DESC, other) AS nth
            FROM scored WHERE same QUALIFY nth <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.place, nth ORDER BY score DESC, other) AS INT) AS rank,
               other AS negative_id, positive_score, score AS negative_score
        FROM positives p JOIN scored s ON s.place = p.place AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        QUALIFY rank <= 5"""
