"""Near-duplicates: min-max hashing, banding, and a check of every link on the full sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .scratch import materialize
from .shingles import mixed, shingle_set
from .workers import give_back, tidy

#: Hash functions; each gives its minimum and its maximum, so a signature has twice as many values.
FUNCTIONS = 180
#: Values in a band. A pair of similarity 0.8 misses all 60 bands with a probability of 1.2e-8.
ROWS = 6
#: Rounds in which each unsettled bucket compares its members with one more of them.
STARS = 1

_BLOCK = 512


@lru_cache(maxsize=4)
def _constants(functions: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    multipliers, addends = draw.integers(0, 2**64, (2, functions), np.uint64)
    return multipliers | np.uint64(1), addends, draw.integers(0, 2**64, 2 * functions, np.uint64) | np.uint64(1)


def min_max_signature(shingles: np.ndarray, functions: int = FUNCTIONS, rows: int = ROWS) -> np.ndarray:
    """Minimum and maximum of the set under each function: ``2 * functions`` 32-bit values."""
    a, b, _ = _constants(functions, rows)
    low, high = np.full(functions, 2**32 - 1, np.uint64), np.zeros(functions, np.uint64)
    for i in range(0, len(shingles), _BLOCK):
        h = shingles[i : i + _BLOCK, None] * a
        h += b
        h >>= np.uint64(32)
        np.minimum(low, h.min(axis=0), out=low)
        np.maximum(high, h.max(axis=0), out=high)
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray, functions: int = FUNCTIONS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` values; the band's place is part of it."""
    _, _, c = _constants(functions, rows)
    keys = (signature * c).reshape(-1, rows).sum(axis=1, dtype=np.uint64)
    return mixed(mixed(keys + np.arange(len(keys), dtype=np.uint64))).view(np.int64)


def _signatures(k: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                sizes, marks, bands = [], [], []
                for text in part.column(1):
                    s = shingle_set(text.as_py(), k)
                    sizes.append(len(s))
                    marks.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bands.append(band_keys(min_max_signature(s)) if len(s) else [])
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.record_batch(columns, names=["id", "n", "mark", "bands"])

    return run


def _linked(k: int, percent: int):
    @F.pandas_udf("boolean")
    def linked(a, b):
        import pandas as pd

        recent: dict[str, np.ndarray] = {}

        def sets(text: str) -> np.ndarray:
            s = recent.get(text)
            if s is None:
                if len(recent) > 64:
                    recent.clear()
                s = recent[text] = shingle_set(text, k)
            return s

        def one(x: str, y: str) -> bool:
            s, t = sets(x), sets(y)
            both = len(np.intersect1d(s, t, assume_unique=True))
            return bool(both) and 100 * both >= percent * (len(s) + len(t) - both)

        give_back()
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    return linked


def _fits(percent: int, n: Column, m: Column) -> Column:
    """Sets whose sizes differ by more cannot be similar enough."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b`` of the columns ``x, y``."""
    return rows.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return materialize(both.where(_linked(k, percent)("text_a", "text_b")).select("a", "b").distinct(), "near-links")


def _unsettled(live: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that still hold more than one component."""
    named = live.select("bucket", "node", "n").join(labels.select("node", "component"), "node", "left")
    named = materialize(named.select("bucket", "node", "n", F.coalesce("component", "node").alias("component")), "near-named")
    mixed_up = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    return materialize(named.join(materialize(mixed_up, "near-unsettled"), "bucket"), "near-live")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links."""
    if links.isEmpty():
        return labels
    return components(links.union(labels.where("node <> component").select("node", "component")))


def _shingle_rows(k: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 500):
                batch = whole.slice(start, 500)
                sets = [shingle_set(t.as_py(), k).view(np.int64) for t in batch.column(1)]
                rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array(np.concatenate(sets))], names=["id", "shingle"])

    return run


def _prefix_pairs(nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """All pairs of nodes in different components that can be similar enough, by their rarest shingles.

    If two sets are similar enough, then in one order of all shingles, here the
    rarest first, the first ones of both share a shingle: for the larger set
    ``n - ceil(t n) + 1`` of them, for the smaller ``n - ceil(2 t n / (1 + t)) + 1``.
    What remains after the first shared one must suffice for the overlap.
    """
    rows = texts.join(nodes.select(F.col("node").alias("id")), "id", "left_semi").mapInArrow(_shingle_rows(k), "id long, shingle long").distinct()
    rows = materialize(rows, "near-shingles")
    often = materialize(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "near-often")
    # A shingle of one node is the rarest there is; it takes a place at the front but never meets another.
    ranked = rows.join(often, "shingle", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("often", "shingle"))).where("often > 1")
    ranked = ranked.join(nodes.withColumnRenamed("node", "id"), "id").select("shingle", "id", "component", "n", "place")
    least = lambda c: -F.floor(-c).cast("long")
    ranked = materialize(ranked.where(F.col("place") <= F.col("n") - least(F.col("n") * percent / 100) + 1), "near-prefixes")
    small = ranked.where(F.col("place") <= F.col("n") - least(2 * percent * F.col("n") / (100 + percent)) + 1)
    small = small.select("shingle", *[F.col(c).alias(f"o_{c}") for c in ("id", "component", "n", "place")])
    rest = 1 + F.least(F.col("n") - F.col("place"), F.col("o_n") - F.col("o_place"))
    enough = (100 + percent) * rest >= percent * (F.col("n") + F.col("o_n"))
    # Ties in size meet once, by id.
    ordered = (F.col("o_n") < F.col("n")) | ((F.col("o_n") == F.col("n")) & (F.col("o_id") < F.col("id")))
    met = ranked.join(small, "shingle").where(ordered & (F.col("component") != F.col("o_component")) & _fits(percent, F.col("n"), F.col("o_n")) & enough)
    return _pairs(met.select(F.col("id").alias("x"), F.col("o_id").alias("y")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """For every row: ``<id_col>, n_shingles, component_id, kept``.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|`` for their
    sets of ``k``-word shingles (A-Z lower-cased). The component is the smallest
    integer id that can be reached over links; that document is kept.

    Equal sets are first reduced to one node. Nodes that share a band meet in a
    bucket. Each bucket compares its members with one of them, links are
    confirmed on the texts, and components form; buckets whose members are all
    in one component are settled. After another round with other members, what
    is still in question, members of unsettled buckets in different components,
    is joined exactly by the rarest shingles of each set, and the pairs that can
    be similar enough are compared. No bucket is gathered in a task.

    Text that is null or has no words gives an empty set, linked with nothing.
    A row without an id is linked with nothing, has a null component and is
    kept. Rows that repeat an id are one document: they share a component, linked
    to what any of its texts is linked to; rows without words stay apart. Sets are
    of 64-bit hashes, so two shingles of one text count as one with a probability
    of about n * n / 2**65. Texts are taken whole, however long. Other columns are
    not looked at; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialize(rows.mapInArrow(_signatures(k), "id long, n long, mark binary, bands array<long>"), "near-signed")
    sets = signed.where("n > 0 and id is not null")
    classes = materialize(sets.groupBy("mark").agg(F.min("id").alias("node")), "near-classes")
    nodes = sets.join(classes.withColumnRenamed("node", "id"), ["mark", "id"])
    members = nodes.select(F.explode("bands").alias("bucket"), F.col("id").alias("node"), "n").distinct()
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("center")).where("size > 1").select("bucket", "center")
    live = materialize(members.join(materialize(buckets, "near-buckets"), "bucket"), "near-live")
    texts = materialize(rows.join(live.select(F.col("node").alias("id")).distinct(), "id", "left_semi"), "near-texts")

    # Texts of one id are one document, though each may have copies of its own.
    owners = materialize(sets.select("id", "mark").distinct().join(classes, "mark"), "near-owners")
    least = materialize(owners.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("id", "a"), "near-repeated")
    same = owners.join(least, "id").where("a < node").select("a", F.col("node").alias("b"))

    tested = materialize(_pairs(live.select(F.col("center").alias("x"), F.col("node").alias("y"))), "near-pairs")
    labels = components(_confirmed(tested, texts, k, percent).union(same))
    for star in range(STARS):
        live = _unsettled(live, labels)
        first = F.min(F.struct(F.xxhash64("node", F.lit(star)), "node", "component", "n")).alias("c")
        other = materialize(live.groupBy("bucket").agg(first).select("bucket", *[F.col(f"c.{c}").alias(f"o_{c}") for c in ("node", "component", "n")]), "near-centers")
        met = live.join(other, "bucket").where((F.col("component") != F.col("o_component")) & _fits(percent, F.col("n"), F.col("o_n")))
        new = _pairs(met.select(F.col("node").alias("x"), F.col("o_node").alias("y"))).join(tested, ["a", "b"], "left_anti")
        new = materialize(new, "near-pairs")
        labels = _joined(labels, _confirmed(new, texts, k, percent))
        tested = tested.union(new)
    live = _unsettled(live, labels)
    new = materialize(_prefix_pairs(live.select("node", "component", "n").distinct(), texts, k, percent).join(tested, ["a", "b"], "left_anti"), "near-pairs")
    labels = _joined(labels, _confirmed(new, texts, k, percent))

    labels = materialize(labels, "near-labels")
    named = signed.select("id", "n", "mark").join(classes, "mark", "left").join(labels, "node", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "node"))
    component = F.when(F.col("id").isNotNull(), component)
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document :func:`near_duplicates` keeps, with all their columns."""
    found = near_duplicates(docs, id_col, text_col, k, percent)
    gone = found.groupBy(F.col(id_col).alias("_gone")).agg(F.max("kept").alias("kept")).where(~F.col("kept")).select("_gone")
    gone = materialize(gone, "near-gone")
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
