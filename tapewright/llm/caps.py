"""Near-duplicates among vectors of one label: spherical-cap filters, balls, and a check of every link.

A filter is a direction; a vector passes it when their inner product exceeds a
height, that is, when the vector lies in the cap around the direction. Directions
come from random product codes: the space is rotated and divided into blocks, each
block has a few random words, and every combination of one word a block is a
direction. All caps that hold a vector are listed block by block, without looking
at the directions one by one. Two vectors with a large cosine share a cap almost
surely, and only vectors that share one are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import discard, materialize

COSINE = 0.93
#: Rotations of the space, blocks of each, words of a block: 16 * 256**2, about a million filters.
ROTATIONS, BLOCKS, WORDS = 16, 2, 256
#: Filters that a random vector passes. Of pairs at a cosine of 0.93 in 64 dimensions, 0.02 % share none.
PASSED = 48
#: Balls of one filter that are compared as one matrix, with those of another such tile.
TILE = 256

#: Radians by which rounding may change an angle.
_MARGIN = 1e-5
_SLICE = 512


@dataclass(frozen=True)
class Code:
    """A random product code for vectors of ``dims`` components."""

    dims: int
    rotations: int = ROTATIONS
    blocks: int = BLOCKS
    words: int = WORDS
    passed: int = PASSED


@lru_cache(maxsize=4)
def _drawn(code: Code) -> tuple[list[tuple[np.ndarray, np.ndarray]], float]:
    """Rotation and words of each rotation, and the height of the caps.

    The height is the one at which random vectors pass ``passed`` filters on
    average; it depends on the code alone.
    """
    draw = np.random.default_rng(20160110)
    width = -(-code.dims // code.blocks)
    tables = []
    for _ in range(code.rotations):
        turn, _ = np.linalg.qr(draw.standard_normal((width * code.blocks,) * 2))
        words = draw.standard_normal((code.blocks, code.words, width))
        tables.append((turn[: code.dims], words / np.linalg.norm(words, axis=2, keepdims=True)))
    sample = draw.standard_normal((1000, code.dims))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    low, high = 0.0, float(code.blocks)
    for _ in range(20):
        height = (low + high) / 2
        n = len(_listed(sample, *tables[0], height)[0]) * code.rotations / len(sample)
        low, high = (height, high) if n > code.passed else (low, height)
    return tables, high


def _listed(vectors: np.ndarray, turn: np.ndarray, words: np.ndarray, height: float) -> tuple[np.ndarray, np.ndarray]:
    """All (row, direction) whose inner product is ``height`` or more, and each row's best direction.

    Partial sums over the first blocks go on only while the best words of the
    others could still lift them to the height.
    """
    blocks, count, width = words.shape
    sides = (vectors @ turn).reshape(len(vectors), blocks, width).transpose(1, 0, 2)
    products = sides @ words.transpose(0, 2, 1)
    best = products.max(axis=2)
    to_come = np.vstack([np.cumsum(best[::-1], axis=0)[::-1], np.zeros(len(vectors))])
    least = np.minimum(height, to_come[0]) - 1e-12
    row, name, total = np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    for i in range(blocks):
        sums = total[:, None] + products[i][row]
        at, word = np.nonzero(sums >= (least - to_come[i + 1])[row, None])
        row, name, total = row[at], name[at] * count + word, sums[at, word]
    return row, name


def filters_of(vectors: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of every filter that unit vectors pass."""
    tables, height = _drawn(code)
    rows, names = [], []
    for i, (turn, words) in enumerate(tables):
        row, name = _listed(vectors, turn, words, height)
        rows.append(row)
        names.append(i * code.words**code.blocks + name)
    return np.concatenate(rows), np.concatenate(names)


def usable_components(vector: Column) -> Column:
    """Whether a vector is there, without null or non-finite components."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, good), F.lit(False))


def usable(vector: Column) -> Column:
    """Whether it isn't zero either."""
    return usable_components(vector) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Vectors that are stored as bytes, one a row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _units(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(np.asarray(lists.offsets))
            out = np.zeros((len(batch), dims))
            out[np.arange(dims) < sizes[:, None]] = np.asarray(lists.flatten())
            out /= np.maximum(np.abs(out).max(axis=1, keepdims=True), np.finfo(float).tiny)
            out /= np.linalg.norm(out, axis=1, keepdims=True)
            unit = pa.array([row.tobytes() for row in out], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), unit], names=["node", "label", "unit"])

    return run


def _entries(code: Code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), _SLICE):
                part = batch.slice(start, _SLICE)
                row, name = filters_of(_matrix(part.column(2)), code)
                row = pa.array(row)
                yield pa.record_batch([part.column(0).take(row), part.column(1).take(row), pa.array(name)], names=["node", "label", "filter"])

    return run


def _dot(a: str, b: str) -> Column:
    """Inner product of two columns of unit vectors."""

    @F.pandas_udf("double")
    def dot(a, b):
        import pandas as pd

        if not len(a):
            return pd.Series([], dtype=float)
        x, y = [np.frombuffer(b"".join(v), np.float64).reshape(len(v), -1) for v in (a, b)]
        return pd.Series(np.clip((x * y).sum(axis=1), -1, 1))

    return dot(a, b)


def _near(cosine: float):
    """Pairs of balls of one tile, or of two, whose members can be linked."""
    widest = math.acos(cosine) + _MARGIN

    def balls(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.array([r["ball"] for r in rows], np.int64)
        units = np.frombuffer(b"".join(r["unit"] for r in rows), np.float64).reshape(len(rows), -1)
        return ids, units, np.array([r["radius"] for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty((0, 2), np.int64)]
            for one, other in zip(batch.column(0), batch.column(1), strict=True):
                a, x, r = balls(one.as_py())
                b, y, s = balls(other.as_py()) if other.is_valid else (a, x, r)
                reach = np.minimum(widest + r[:, None] + s[None, :], math.pi)
                i, j = np.nonzero(x @ y.T >= np.cos(reach) - 1e-9)
                i, j = (i[i < j], j[i < j]) if not other.is_valid else (i, j)
                found.append(np.stack([np.minimum(a[i], b[j]), np.maximum(a[i], b[j])], 1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _crowded(entries: DataFrame, owner: str) -> DataFrame:
    """The entries of filters that more than one passes."""
    sizes = entries.groupBy("label", "filter").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return entries.join(materialize(sizes, "caps-sizes"), ["label", "filter"]).select("label", "filter", owner, "size")


def _rank(node: str) -> Column:
    return F.xxhash64(F.col(node))


def _balls(entries: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """``node, ball, angle``: the ball that each node belongs to, and its angle to the ball's center.

    In each filter the node with the least hash is the pivot. A node joins the
    pivot with the least hash, its own included, among those within half of the
    angle of the least cosine: any two members of a ball are then linked. The pivots
    of the filters around a dense spot are mostly one node, so a spot with any number of
    vectors has few balls.
    """
    half = math.acos(cosine) / 2 - _MARGIN
    pivot = F.min(F.struct(_rank("node"), "node")).alias("p")
    crowded = _crowded(entries, "node")
    pivots = materialize(crowded.groupBy("label", "filter").agg(pivot).select("label", "filter", F.col("p.node").alias("pivot")), "caps-pivots")
    met = crowded.join(pivots, ["label", "filter"]).where("node <> pivot").where(_rank("pivot") <= _rank("node"))
    met = met.select("node", "pivot").distinct()
    units = nodes.select("node", "unit")
    met = met.join(units, "node").join(units.select(F.col("node").alias("pivot"), F.col("unit").alias("center")), "pivot")
    met = met.select("node", "pivot", F.acos(_dot("unit", "center")).alias("angle")).where(F.col("angle") <= half)
    chosen = met.groupBy("node").agg(F.min(F.struct(_rank("pivot").alias("rank"), "pivot", "angle")).alias("c"))
    chosen = chosen.select("node", F.col("c.pivot").alias("ball"), F.col("c.angle").alias("angle"))
    own = nodes.select("node").join(materialize(chosen, "caps-chosen"), "node", "left")
    return materialize(own.select("node", F.coalesce("ball", "node").alias("ball"), F.coalesce("angle", F.lit(0.0)).alias("angle")), "caps-members")


def _ball_pairs(entries: DataFrame, members: DataFrame, balls: DataFrame, cosine: float) -> DataFrame:
    """Pairs ``a < b`` of balls of which members share a filter and can be linked.

    The balls of a filter are dealt to tiles by hash. Each tile is compared with itself
    and with every other tile of its filter, as matrices: the pairs that are too far
    apart, nearly all, never become rows.
    """
    passed = entries.join(members.select("node", "ball"), "node").select("label", "filter", "ball").distinct()
    passed = _crowded(materialize(passed, "caps-passed"), "ball").withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int"))
    passed = passed.withColumn("tile", F.pmod(F.xxhash64("ball", "filter"), F.col("tiles")).cast("int"))
    passed = passed.join(balls.select("ball", "unit", "radius"), "ball")
    tiles = passed.groupBy("label", "filter", "tiles", "tile").agg(F.collect_list(F.struct("ball", "unit", "radius")).alias("balls"))
    tiles = materialize(tiles, "caps-tiles")
    nothing = F.lit(None).cast(tiles.schema["balls"].dataType)
    alone = tiles.select(F.col("balls").alias("one"), nothing.alias("other"))
    one = tiles.where("tile < tiles - 1").select("label", "filter", F.col("tile").alias("i"), F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)).alias("j"), F.col("balls").alias("one"))
    other = tiles.where("tile > 0").select("label", "filter", F.explode(F.sequence(F.lit(0), F.col("tile") - 1)).alias("i"), F.col("tile").alias("j"), F.col("balls").alias("other"))
    both = alone.union(one.join(other, ["label", "filter", "i", "j"]).select("one", "other"))
    pairs = materialize(both.mapInArrow(_near(cosine), "a long, b long").distinct(), "caps-pairs")
    discard(tiles)
    return pairs


def _side(balls: DataFrame, name: str) -> DataFrame:
    return balls.select(F.col("ball").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("unit", "radius", "weight")])


def _links(pairs: DataFrame, balls: DataFrame, members: DataFrame, nodes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links beyond the balls: ``ball, n`` for all members of a ball, ``node, n`` for single ones, and edges ``a, b`` between balls.

    Two balls whose farthest members must be linked, or whose nearest can't be,
    are settled as they are; single vectors always are. Of other pairs, each member of one is
    held against the other's center in the same way, and what is still open against its members.
    """
    most = math.acos(cosine)
    angle = F.acos(F.col("c"))
    exact = F.col("c") >= cosine
    met = pairs.join(_side(balls, "a"), "a").join(_side(balls, "b"), "b").withColumn("c", _dot("unit_a", "unit_b"))
    reach = F.col("radius_a") + F.col("radius_b")
    full = F.when(reach == 0, exact).otherwise(angle + reach <= most - _MARGIN)
    none = F.when(reach == 0, ~exact).otherwise(angle - reach > most + _MARGIN)
    met = met.select("a", "b", "weight_a", "weight_b", full.alias("full"), none.alias("none")).where("not none")
    met = materialize(met.drop("none"), "caps-met")
    settled = met.where("full")
    whole = settled.select(F.col("a").alias("ball"), F.col("weight_b").alias("n")).union(settled.select("b", "weight_a"))

    open_ = met.where("not full")
    sides = open_.select(F.col("a").alias("ball"), F.col("b").alias("far")).union(open_.select("b", "a"))
    far = balls.select(F.col("ball").alias("far"), F.col("unit").alias("center"), "radius", F.col("weight").alias("far_weight"))
    own = members.select("node", "ball").join(nodes.select("node", "unit"), "node")
    single = sides.join(far, "far").join(own, "ball").withColumn("c", _dot("unit", "center"))
    sure = F.when(F.col("radius") == 0, exact).otherwise(angle + F.col("radius") <= most - _MARGIN)
    out = F.when(F.col("radius") == 0, ~exact).otherwise(angle - F.col("radius") > most + _MARGIN)
    single = single.select("ball", "far", "node", "far_weight", sure.alias("sure"), out.alias("out")).where("not out")
    single = materialize(single.drop("out"), "caps-single")
    theirs = members.select(F.col("node").alias("partner"), F.col("ball").alias("far")).join(
        nodes.select(F.col("node").alias("partner"), F.col("unit").alias("theirs"), F.col("weight").alias("n")), "partner"
    )
    pairwise = single.where("not sure").join(theirs, "far").join(nodes.select("node", "unit"), "node")
    pairwise = pairwise.withColumn("c", _dot("unit", "theirs")).where(exact)
    pairwise = materialize(pairwise.groupBy("ball", "far", "node").agg(F.sum("n").alias("n")), "caps-pairwise")
    sure_rows = single.where("sure")
    singly = sure_rows.select("node", F.col("far_weight").alias("n")).union(pairwise.select("node", "n"))
    edges = settled.select("a", "b").union(sure_rows.select("ball", "far")).union(pairwise.select("ball", "far"))
    return whole.groupBy("ball").agg(F.sum("n").alias("whole")), singly.groupBy("node").agg(F.sum("n").alias("singly")), edges


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    rotations: int = ROTATIONS,
    blocks: int = BLOCKS,
    words: int = WORDS,
    passed: int = PASSED,
) -> DataFrame:
    """For every row: ``<id_col>, n_links, component_id, kept``.

    Two rows are linked when their labels are equal and not null and their vectors'
    cosine, in double precision, is ``cosine`` or more. ``n_links`` counts the rows
    that one is linked with, ``component_id`` is the least id that can be reached,
    and rows with that id are kept.

    Equal vectors are one node. Nodes that share a filter meet; those within half of
    the angle around a pivot are a ball, in which all are linked with all, so that a
    hot group of near copies costs its size and not its square. Balls are compared
    by tiles, and what two balls leave open is compared vector by vector. A pair is
    missed only if no members of the two balls share a filter.

    A vector that is null, empty or zero, or has null or non-finite components, and
    a row with a null label, is linked with nothing. Shorter vectors end in zeros.
    Rows that repeat an id count each by itself and are kept or not together. A row with
    a null id is linked like any other; if it reaches no id, its component is null and it is
    kept. Other columns are not looked at; an empty table gives an empty result.
    """
    label = F.col(label_col).cast("string")
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable(vector), label).alias("label"), vector.alias("vector"))
    rows = rows.withColumn("vector", F.when(F.col("label").isNotNull(), F.col("vector")))
    rows = materialize(rows.withColumn("node", F.monotonically_increasing_id()), "caps-rows")
    dims = rows.agg(F.max(F.size("vector"))).first()[0]
    if dims is None or dims < 1:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    code = Code(dims, rotations, blocks, words, passed)

    live = rows.where(F.col("label").isNotNull())
    # The first of equal vectors is their node.
    named = live.select("node", "id", "label", F.md5(F.to_json("vector").cast("binary")).alias("mark"))
    named = materialize(named, "caps-named")
    classes = named.groupBy("label", "mark").agg(F.min("node").alias("first"), F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"))
    classes = materialize(classes, "caps-classes")
    nodes = live.join(classes.select(F.col("first").alias("node"), "weight"), "node")
    units = nodes.select("node", "label", "vector").mapInArrow(_units(dims), "node long, label string, unit binary")
    units = materialize(units, "caps-units")
    nodes = materialize(units.join(classes.select(F.col("first").alias("node"), "weight", "least"), "node"), "caps-nodes")
    entries = materialize(units.mapInArrow(_entries(code), "node long, label string, filter long"), "caps-entries")

    members = _balls(entries, nodes, cosine)
    sums = members.join(nodes.select("node", "weight", "least"), "node").groupBy("ball")
    # A ball of one vector has no radius; rounding counts as a part of any other's.
    radius = F.when(F.max("angle") > 0, F.max("angle") + 1e-7).otherwise(F.when(F.count(F.lit(1)) > 1, F.lit(1e-7)).otherwise(F.lit(0.0)))
    sums = sums.agg(radius.alias("radius"), F.sum("weight").alias("weight"), F.min("least").alias("least"))
    balls = materialize(sums.join(nodes.select(F.col("node").alias("ball"), "unit"), "ball"), "caps-balls")
    pairs = _ball_pairs(entries, members, balls, cosine)
    whole, singly, edges = _links(pairs, balls, members, nodes, cosine)

    reached = components(edges)
    reached = balls.select("ball", "least").join(reached.withColumnRenamed("node", "ball"), "ball", "left")
    reached = reached.select("ball", "least", F.coalesce("component", "ball").alias("component"))
    reached = materialize(reached, "caps-reached")
    least = reached.groupBy("component").agg(F.min("least").alias("component_id"))
    of_ball = reached.select("ball", "component").join(least, "component").join(whole, "ball", "left").join(balls.select("ball", "weight"), "ball")
    of_node = members.select("node", "ball").join(of_ball, "ball").join(singly, "node", "left")
    links = F.col("weight") - 1 + F.coalesce("whole", F.lit(0)) + F.coalesce("singly", F.lit(0))
    of_node = materialize(of_node.select(F.col("node").alias("first"), links.cast("long").alias("n_links"), "component_id"), "caps-linked")
    of_class = classes.select("label", "mark", "first").join(of_node, "first").select("label", "mark", "n_links", "component_id")
    found = named.join(materialize(of_class, "caps-found"), ["label", "mark"]).select("id", "n_links", "component_id")
    rest = rows.where(F.col("label").isNull()).select("id", F.lit(0).cast("long"), "id")
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return found.union(rest).select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


def oracle() -> str:
    """The same in DuckDB's SQL: all pairs of a label, and the ids that can be reached."""
    return f"""
        WITH RECURSIVE usable AS MATERIALIZED (
            SELECT row_number() OVER () AS place, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS MATERIALIZED (
            SELECT a.place AS a, b.place AS b, a.vec_id AS id_a, b.vec_id AS id_b FROM usable a JOIN usable b ON a.label = b.label AND a.place <> b.place
            WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)) / sqrt(list_inner_product(b.v, b.v)) >= {COSINE}),
        reach AS (
            SELECT place, vec_id AS least FROM usable
            UNION
            SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.place),
        least AS (SELECT place, min(least) AS component_id FROM reach GROUP BY place),
        counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM usable JOIN least USING (place) LEFT JOIN counted ON a = usable.place
        UNION ALL
        SELECT vec_id, 0, vec_id, TRUE FROM embeddings
        WHERE NOT (label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0) IS TRUE"""
