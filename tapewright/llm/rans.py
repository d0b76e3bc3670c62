"""Token-id files coded with a static range asymmetric numeral system.

The format is a table of independent blocks. A block holds whole documents in
ascending id order: their ids and lengths, the coded token ids, and checkpoints.
Frequencies are counted once over the whole corpus, scaled to ``2**SCALE`` and
stored beside the blocks. Inside a block ``LANES`` coders take turns (symbol
``i`` belongs to lane ``i % LANES``), so that one step codes ``LANES`` symbols
at once; every ``CHECKPOINT`` steps the coders' states and the place in the
words are kept, from where decoding may start. Each block has a checksum of its
ids, which decoding verifies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import default_vocabulary, encoder, slices
from .scratch import materialize, shared_folder

SCALE = 20
LANES = 256
#: Steps from one checkpoint to the next.
CHECKPOINT = 256
#: A block is closed once it holds so many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 18
END_ID = 1

_LOW = np.uint64(1 << 31)
_U32 = np.uint64(32)
_BITS = np.uint64(SCALE)
_MASK = np.uint64((1 << SCALE) - 1)

BLOCK_SCHEMA = "part int, block long, n_ids long, doc_ids binary, doc_lengths binary, lanes int, words binary, states binary, places binary, checksum long"


def scaled_frequencies(counts: np.ndarray) -> np.ndarray:
    """Frequencies with sum ``2**SCALE``, at least 1 for each symbol that occurs."""
    total, seen = int(counts.sum()), counts > 0
    if not total:
        return np.zeros(len(counts), np.uint64)
    room = (1 << SCALE) - int(seen.sum())
    if room < 0:
        raise ValueError("more symbols than the scale has places")
    scaled = np.array([int(c) * room // total for c in counts], np.int64) + seen
    scaled[np.argmax(scaled)] += (1 << SCALE) - scaled.sum()
    return scaled.astype(np.uint64)


class Coder:
    """Encodes and decodes blocks under one frequency table."""

    def __init__(self, frequencies: np.ndarray):
        self.freq = frequencies.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        self.filler = int(np.argmax(self.freq))

    def encode(self, ids: np.ndarray, lanes: int = LANES) -> tuple[bytes, bytes, bytes]:
        """Words in the order in which they are read, states and places of the checkpoints."""
        steps = -(-len(ids) // lanes)
        grid = np.full(steps * lanes, self.filler, np.int64)
        grid[: len(ids)] = ids
        grid = grid.reshape(steps, lanes)
        x, words, states = np.full(lanes, _LOW, np.uint64), [], []
        room = np.uint64(63 - SCALE)
        for step in range(steps - 1, -1, -1):
            f = self.freq[grid[step]]
            full = x >= (f << room)
            words.append(x[full].astype("<u4"))
            x = np.where(full, x >> _U32, x)
            q = x // f
            x = (q << _BITS) + (x - q * f) + self.start[grid[step]]
            if step % CHECKPOINT == 0:
                states.append(x.astype("<u8"))
        words.reverse()
        sizes = np.array([len(w) for w in words], np.int64)
        places = (np.cumsum(sizes) - sizes)[::CHECKPOINT]
        join = lambda parts, kind: np.concatenate(parts).tobytes() if parts else b""
        return join(words, "<u4"), join(states[::-1], "<u8"), places.astype("<u8").tobytes()

    def decode(self, n: int, words: bytes, states: bytes, places: bytes, lanes: int = LANES, first: int = 0) -> np.ndarray:
        """Ids from checkpoint ``first`` on, at most ``n`` from the block's start."""
        stream = np.frombuffer(words, "<u4").astype(np.uint64)
        steps = -(-n // lanes)
        if first * CHECKPOINT >= steps:
            return np.empty(0, np.uint32)
        x = np.frombuffer(states, "<u8").reshape(-1, lanes)[first].astype(np.uint64)
        at = int(np.frombuffer(places, "<u8")[first])
        out = np.empty((steps - first * CHECKPOINT, lanes), np.uint32)
        for step in range(len(out)):
            slot = x & _MASK
            s = self.symbol[slot]
            out[step] = s
            x = self.freq[s] * (x >> _BITS) + slot - self.start[s]
            low = x < _LOW
            k = int(np.count_nonzero(low))
            if k:
                x[low] = (x[low] << _U32) | stream[at : at + k]
                at += k
        return out.ravel()[: n - first * CHECKPOINT * lanes]


@lru_cache(maxsize=2)
def _coder(table: bytes) -> Coder:
    return Coder(np.frombuffer(table, "<u8"))


def _checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _token_blocks(docs: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """Blocks of ids in ascending id order: ``part, block, doc_ids, doc_lengths, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, enc, end = TaskContext.get().partitionId(), 0, encoder(vocabulary), np.array([END_ID], "<u2")
        docs, lengths, held, size = [], [], [], 0

        def closed() -> pa.RecordBatch:
            columns = [[part], [block], [np.array(docs, "<i8").tobytes()], [np.array(lengths, "<i8").tobytes()], [np.concatenate(held).tobytes()]]
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "block", "doc_ids", "doc_lengths", "ids"])

        for whole in batches:
            for batch in slices(whole, "text"):
                ids, ends = enc.encode(batch.column("text"))
                for doc, (low, high) in zip(batch.column("id").to_pylist(), pairwise(ends), strict=True):
                    if size and size + high - low >= BLOCK_IDS:
                        yield closed()
                        docs, lengths, held, size, block = [], [], [], 0, block + 1
                    docs.append(doc)
                    lengths.append(high - low + 1)
                    held += [ids[low:high], end]
                    size += high - low + 1
        if size:
            yield closed()

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id")
    return materialize(rows.mapInArrow(run, "part int, block long, doc_ids binary, doc_lengths binary, ids binary"), "rans-ids")


def _count(blocks: DataFrame, symbols: int) -> np.ndarray:
    """How often each id occurs in all blocks; at most ``symbols`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(symbols, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_py(), "<u2"), minlength=symbols)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["symbol", "n"])

    counts = np.zeros(symbols, np.int64)
    for row in blocks.select("ids").mapInArrow(run, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        counts[row["symbol"]] = row["n"]
    return counts


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> None:
    """Encode every document, append the end id, and write coded blocks to ``path``.

    Null text is empty: the end id alone. Ids are integers; rows that repeat an
    id stand next to each other in any order, and rows without one come first.
    Other columns are not looked at. An empty table gives files without blocks.
    """
    vocabulary = vocabulary or default_vocabulary()
    blocks = _token_blocks(docs, id_col, text_col, vocabulary)
    symbols = max(encoder(vocabulary).size, END_ID + 1)
    table = scaled_frequencies(_count(blocks, symbols)).astype("<u8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(table)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<u2")
                lanes = LANES if len(ids) >= 16 * LANES else 16
                words, states, places = coder.encode(ids, lanes)
                out = {"part": row["part"], "block": row["block"], "n_ids": len(ids), "doc_ids": row["doc_ids"], "doc_lengths": row["doc_lengths"], "lanes": lanes}
                out |= {"words": words, "states": states, "places": places, "checksum": _checksum(ids)}
                yield pa.RecordBatch.from_pylist([out], schema=_ARROW)

    # One block a row: few rows a batch keep a task's memory at a few blocks.
    blocks.mapInArrow(run, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    docs.sparkSession.createDataFrame([(SCALE, bytearray(table))], "scale int, frequencies binary").coalesce(1).write.parquet(f"{path}/frequencies")


_ARROW = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("doc_lengths", pa.binary()),
        ("lanes", pa.int32()), ("words", pa.binary()), ("states", pa.binary()), ("places", pa.binary()), ("checksum", pa.int64()),
    ]
)


def decoded_blocks(batches: Iterator[pa.RecordBatch], table: bytes) -> Iterator[tuple[dict, np.ndarray]]:
    """Each block's row and its ids, checked."""
    coder = _coder(table)
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            ids = coder.decode(row["n_ids"], row["words"], row["states"], row["places"], row["lanes"])
            if _checksum(ids) != row["checksum"]:
                raise ValueError(f"block {row['part']}/{row['block']} is damaged")
            yield row, ids


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Decode the files: ``<id_col>, start, n_tokens, ids_crc32`` for each document, and its ``ids`` if asked for."""
    table = bytes(spark.read.parquet(f"{path}/frequencies").first()["frequencies"])
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    # Where each block starts: a sum over parts, then one over the blocks of a part.
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier(Window.partitionBy(F.lit(0)).orderBy("part"))), F.lit(0)).alias("parts_before"))
    inside = F.coalesce(F.sum("n_ids").over(earlier(Window.partitionBy("part").orderBy("block"))), F.lit(0))
    bases = sizes.withColumn("inside", inside).join(parts, "part").select("part", "block", (F.col("parts_before") + F.col("inside")).alias("base"))
    bases = materialize(bases, "rans-bases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ids in decoded_blocks(batches, table):
            docs, lengths = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_lengths"], "<i8")
            ends = np.cumsum(lengths)
            wide = memoryview(ids.astype("<u4").tobytes())
            cut = [wide[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            columns = [
                pa.array([row["part"]] * len(docs), pa.int32()), pa.array([row["block"]] * len(docs), pa.int64()),
                pa.array(docs, pa.int64(), mask=docs == -(2**63)), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array([bytes(c) if with_ids else None for c in cut], pa.binary()),
            ]
            yield pa.record_batch(columns, names=["part", "block", "id", "inside", "n_tokens", "ids_crc32", "ids"])

    docs = blocks.mapInArrow(run, "part int, block long, id long, inside long, n_tokens long, ids_crc32 long, ids binary")
    out = docs.join(bases, ["part", "block"]).select(F.col("id").alias(id_col), (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
    return out


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Write the token files to a new place in the shared folder and read them back."""
    import uuid

    path = f"{shared_folder(docs.sparkSession)}/tapewright/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, id_col, text_col, vocabulary)
    return read_token_files(docs.sparkSession, path, id_col)
