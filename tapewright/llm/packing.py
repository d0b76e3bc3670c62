"""Mixture-controlled packing of token ids into sequences of one length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import default_vocabulary, encoder, slices
from .scratch import materialize
from .workers import tidy

SEQUENCE = 2048
END_ID = 1
#: A source with fewer tokens a sequence shares one queue with its like, else its documents would be cut into crumbs; so
#: there are at most SEQUENCE / LEAST queues of their own beside those that a mixture names.
LEAST = 32


def tokens_of(docs: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str) -> DataFrame:
    """Every row's ids with the end id, ``part`` and ``before``: ids of its source before it in its part.

    The result is written out, so a part stays the same when tasks run again.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, enc = TaskContext.get().partitionId(), {}, encoder(vocabulary)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, ends = enc.encode(batch.column("text"))
                coded, before = [], []
                for i, source in enumerate(batch.column("source").to_pylist()):
                    coded.append(ids[ends[i] : ends[i + 1]].tobytes() + END_ID.to_bytes(2, "little"))
                    before.append(held.get(source, 0))
                    held[source] = before[-1] + len(coded[-1]) // 2
                n = np.diff(ends) + 1
                columns = [batch.column("id"), batch.column("source"), pa.array([part] * len(batch), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(coded, pa.binary())]
                yield pa.record_batch(columns, names=["id", "source", "part", "before", "n", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return materialize(rows.mapInArrow(run, f"id {kind}, source string, part int, before long, n long, ids binary"), "pack-tokens")


@dataclass(frozen=True)
class Run:
    """Successive sequences that are filled alike.

    ``base`` has each queue's ids used before. With ``takes`` it is one sequence
    that takes so many ids from each queue. Else sequence ``t`` starts where the
    first ``q`` queues together have given ``upto[q] * t * size // upto[-1]``
    ids: each gets its quantum, and what rounding withholds from a queue in one
    round is its deficit in the next. The deficit before any sequence follows from
    ``t`` alone, so tasks need not wait for one another.
    """

    first: int
    count: int
    base: tuple[int, ...]
    upto: tuple[int, ...]
    takes: tuple[int, ...] | None
    size: int

    def given(self, q: int, t: int) -> int:
        """Ids that the first ``q`` queues give together in this run before sequence ``first + t``."""
        if self.takes is not None:
            return sum(self.takes[:q]) if t else 0
        return self.upto[q] * t * self.size // self.upto[-1]

    def start(self, q: int, t: int) -> int:
        """Where queue ``q`` stands before sequence ``first + t``."""
        return self.base[q] + self.given(q + 1, t) - self.given(q, t)


def _one_sequence(weights: list[int], left: list[int], size: int) -> list[int]:
    """Deficit round-robin over queues of which some run dry in this sequence.

    Queues of weight 0 give nothing until the others are dry, and then by what they have left.
    """
    takes, deficit = [0] * len(left), [0.0] * len(left)
    room = min(size, sum(left))
    while room:
        rest = [n - took for n, took in zip(left, takes, strict=True)]
        alive = [q for q, n in enumerate(rest) if n and weights[q]]
        share = weights if alive else rest
        alive = alive or [q for q, n in enumerate(rest) if n]
        total = sum(share[q] for q in alive)
        shared = room
        for q in alive:
            deficit[q] += shared * share[q] / total
            take = min(int(deficit[q]), left[q] - takes[q], room)
            if not take and q == alive[-1] and room == shared:
                take = 1
            takes[q] += take
            deficit[q] -= take
            room -= take
    return takes


def schedule(totals: list[int], weights: list[int] | None = None, size: int = SEQUENCE) -> list[Run]:
    """Runs that use up all queues, with each queue's share of every sequence after its weight.

    Without weights a queue's share is its share of all ids, and all run dry
    together. With weights the rest share what an empty queue leaves, after their
    weights; queues of weight 0 give nothing until no other has ids left, and then
    by what they have. Weights are whole numbers from 0; one so small that it gives
    under an id a sequence gives one.
    """
    if weights and min(weights) < 0:
        raise ValueError(f"weights must not be negative: {weights}")
    if len(totals) >= size:
        raise ValueError(f"{len(totals)} queues can't share sequences of {size} ids")
    left, base, first, runs = list(totals), [0] * len(totals), 0, []
    while sum(left):
        alive = [(weights or totals)[q] if left[q] else 0 for q in range(len(left))]
        if not sum(alive):
            alive = list(left)
        # Every queue that gives anything gives an id a sequence at least, else a difference of two rounded sums can
        # fall. In units this fine that raises no other weight; the least is such that raised ones still have their id.
        alive = [w * size for w in alive]
        least = -(-sum(alive) // (size - len(alive)))
        alive = [max(w, least) if w else 0 for w in alive]
        upto = [0]
        for w in alive:
            upto.append(upto[-1] + w)
        count = min(n * upto[-1] // (w * size) for w, n in zip(alive, left, strict=True) if w)
        takes = None if count else tuple(_one_sequence(alive, left, size))
        run = Run(first, max(count, 1), tuple(base), tuple(upto), takes, size)
        base = [run.start(q, run.count) for q in range(len(left))]
        left = [n - b for n, b in zip(totals, base, strict=True)]
        first += run.count
        runs.append(run)
    return runs


def cuts(runs: list[Run], q: int, at: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """Pieces of the ids ``at .. at + n`` of queue ``q``: (start in them, length, sequence, offset)."""
    done = 0
    for i, run in enumerate(runs):
        end = runs[i + 1].base[q] if i + 1 < len(runs) else None
        if end is not None and at + done >= end:
            continue
        if done == n:
            return
        t, weight = 0, run.upto[q + 1] - run.upto[q]
        if run.takes is None and weight:
            t = min(run.count - 1, max(0, (at + done - run.base[q]) * run.upto[-1] // (weight * run.size)))
            while t and run.start(q, t) > at + done:
                t -= 1
        while t < run.count and done < n:
            low, high = run.start(q, t), run.start(q, t + 1)
            if high > at + done:
                take = min(high - at, n) - done
                yield done, take, run.first + t, run.given(q, t + 1) - run.given(q, t) + at + done - low
                done += take
            t += 1


def _queues(totals: DataFrame, mixture: dict[str, int] | None, size: int) -> tuple[list[str], list[int], list[int] | None]:
    """Sources with a queue of their own, and the queues' ids; the queue past them is the others'.

    With a mixture these are the sources that it names, so that its key '' is the weight of all others together.
    """
    by_source = totals.groupBy("source").agg(F.sum("n").alias("n"))
    everything = by_source.agg(F.sum("n")).first()[0] or 0
    # At most size / LEAST sources can have that large a share, and a mixture names few.
    chosen = F.col("n") * (size // LEAST) >= everything
    if mixture is not None:
        chosen = F.col("source").isin([n for n in mixture if n])
    own = by_source.where(chosen).orderBy(F.desc("n"), "source").collect()
    names, counts = [r["source"] for r in own], [r["n"] for r in own]
    if rest := everything - sum(counts):
        counts.append(rest)
    if mixture is None:
        return names, counts, None
    return names, counts, [mixture.get(s, 0) for s in [*names, *[""] * (len(counts) - len(names))]]


def _interleaved(tokens: DataFrame, totals: DataFrame, names: list[str]) -> DataFrame:
    """``id, at, n, ids`` of the shared queue: every source's documents spread evenly over it.

    A document's key is the share of its source that lies before its middle, so
    that any stretch of the queue has the sources' shares to within a document.
    Places are prefix sums over the parts of one sort; no task sees all of it.
    """
    over = Window.partitionBy("source")
    earlier = over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    small = totals.where(~F.col("source").isin(names))
    small = small.select("part", "source", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.sum("n").over(over).alias("whole"))
    rows = tokens.join(materialize(small, "pack-small"), ["part", "source"])
    place = F.col("base") + F.col("before")
    rows = rows.select("id", "source", "n", "ids", place.alias("place"), ((place + F.col("n") / 2) / F.col("whole")).alias("key"))
    rows = rows.repartitionByRange("key", "source", "place").sortWithinPartitions("key", "source", "place").select("id", "n", "ids")
    kind = rows.schema["id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = held + np.cumsum(batch.column("n").to_numpy())
            columns = [*batch.columns, pa.array([part] * len(batch), pa.int32()), pa.array(ends - batch.column("n").to_numpy(), pa.int64())]
            held = int(ends[-1]) if len(batch) else held
            yield pa.record_batch(columns, names=["id", "n", "ids", "part", "before"])

    rows = materialize(rows.mapInArrow(run, f"id {kind}, n long, ids binary, part int, before long"), "pack-interleaved")
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each part.
    bases = rows.groupBy("part").agg(F.sum("n").alias("m")).select("part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("base"))
    return rows.join(materialize(bases, "pack-bases"), "part").select("id", (F.col("base") + F.col("before")).alias("at"), "n", "ids")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mixture: dict[str, int] | None = None, vocabulary: str | None = None, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Pack all documents; one row per piece of a document in a sequence.

    Columns: ``<id_col>, start`` (ids of the document before the piece),
    ``length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for,
    ``ids``. A document is its ids and the end id. Each source is a queue in
    storage order. Every sequence takes from each queue its share, so only the last
    sequence can be short. Shares are those of all ids, or follow ``mixture``: a whole
    number per source, key '' for all together that it does not name. When a queue
    is dry, the others share its part. A weight of 0, as of unnamed sources without
    the key '', means nothing until all weighted ones are dry. Without a mixture,
    sources with under ``LEAST`` ids a sequence share a queue; with one, all that it
    does not name do. Each one's documents are spread evenly over that queue.
    Queues are logical: a document's place in its queue is a prefix sum over the
    counts of the parts, and no queue is gathered, however large.

    Null text is empty: the end id alone. A null source is the empty one. Ids
    may be null or repeat; each row is packed, equal rows one after the other.
    Texts are encoded whole, however long, and cut where a sequence ends. An empty
    table gives an empty result. Other columns are not looked at.
    """
    vocabulary = vocabulary or default_vocabulary()
    tokens = tokens_of(docs, id_col, text_col, source_col, vocabulary)
    totals = materialize(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "pack-totals")
    names, counts, weights = _queues(totals, mixture, size)
    runs = schedule(counts, weights, size)
    number = F.lit(None).cast("int")
    for q, name in enumerate(names):
        number = F.when(F.col("source") == name, F.lit(q)).otherwise(number)
    over = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn("queue", number).where("queue is not null").withColumn("base", F.coalesce(F.sum("n").over(over), F.lit(0)))
    bases = materialize(bases.select("part", "source", "queue", "base"), "pack-bases")
    placed = tokens.join(bases, ["part", "source"]).select("id", "queue", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    if len(counts) > len(names):
        rest = _interleaved(tokens, totals, names).withColumn("queue", F.lit(len(names)))
        placed = placed.unionByName(rest)
    kind = placed.schema["id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "ids", 500_000):
                which, rows = [], []
                for i, (queue, at, n, ids) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("queue", "at", "n", "ids")], strict=True)):
                    wide = memoryview(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
                    for start, length, sequence, offset in cuts(runs, queue, at, n):
                        piece = wide[4 * start : 4 * (start + length)]
                        which.append(i)
                        rows.append((start, length, zlib.crc32(piece), n, sequence, offset, bytes(piece) if with_ids else None))
                columns = [batch.column("id").take(pa.array(which, pa.int64()))]
                columns += [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:6] or [[]] * 6]
                columns.append(pa.array([r[6] for r in rows], pa.binary()))
                yield pa.record_batch(columns, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    out = placed.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out if with_ids else out.drop("ids")
