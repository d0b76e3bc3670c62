"""BPE encoding that reuses content-defined chunks, and decoding.

Texts are cut where a rolling hash of the last bytes says so, anywhere in a
word too. Equal chunks, within a text or across texts, get their ids once from
a worker's store. A cut spoils the ids of the words beside it: each join is
re-encoded with the tokenizers library over a few words, and over more until
the result agrees at both ends with the ids of the chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WordEncoder, default_vocabulary, encoder, slices

#: Bytes that the rolling hash sees, and the bits that must be zero at a cut: chunks of some 500 bytes.
WINDOW, BITS = 16, 9
#: Words that a chunk holds at least.
LEAST_WORDS = 8
#: Bytes that a worker's store holds in each of its two generations.
BYTES_KEPT = 32_000_000

_FACTOR = np.uint32(2654435761)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte a hash of the ``WINDOW`` bytes that end there; fewer at the start."""
    b = (data.astype(np.uint32) + np.uint32(1)) * _FACTOR
    b ^= b >> np.uint32(15)
    h, power = b.copy(), np.uint32(1)
    for j in range(1, WINDOW):
        power = np.uint32(int(power) * 16777619 & 0xFFFFFFFF)
        h[j:] += b[:-j] * power
    h ^= h >> np.uint32(16)
    return h * _FACTOR


def cut_places(data: bytes) -> list[int]:
    """Where a text is cut, from 0 to its length; every chunk but the only one has ``LEAST_WORDS`` words."""
    a = np.frombuffer(data, np.uint8)
    if len(a) <= WINDOW:
        return [0, len(a)]
    found = np.flatnonzero((rolling_hash(a)[:-1] >> np.uint32(32 - BITS)) == 0) + 1
    # Not within a character, nor where the hash does not have all its bytes yet.
    found = found[(found >= WINDOW) & (a[found] & 0xC0 != 0x80)]
    if not len(found):
        return [0, len(a)]
    space = (a == 32) | ((a >= 9) & (a <= 13))
    begun = np.cumsum(~space & np.concatenate([[True], space[:-1]]))
    words, cuts, held = begun[found - 1].tolist(), [0], 0
    for place, n in zip(found.tolist(), words, strict=True):
        if n - held >= LEAST_WORDS:
            cuts.append(place)
            held = n
    if len(cuts) > 1 and int(begun[-1]) - held < LEAST_WORDS:
        cuts.pop()
    return [*cuts, len(a)]


class ChunkStore:
    """Ids of the chunks met so far, by 128-bit content hash."""

    def __init__(self, words: WordEncoder):
        self.words = words
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = self.reused = self.encoded = 0

    def _put(self, key: bytes, ids: bytes) -> None:
        if self.size > BYTES_KEPT:
            self.old, self.young, self.size = self.young, {}, 0
        self.young[key] = ids
        self.size += len(ids) + 150

    def ids_of(self, chunks: dict[bytes, bytes]) -> dict[bytes, bytes]:
        """Ids of the given chunks, by key; those that are not in the store are encoded, all at once."""
        out, fresh = {}, []
        for key in chunks:
            ids = self.young.get(key)
            if ids is None and (ids := self.old.get(key)) is not None:
                self._put(key, ids)
            if ids is None:
                fresh.append(key)
            else:
                out[key] = ids
        self.reused += len(out)
        self.encoded += len(fresh)
        if fresh:
            ids, ends = self.words.encode(pa.array([chunks[k] for k in fresh], pa.binary()).cast(pa.string()))
            for i, key in enumerate(fresh):
                out[key] = ids[ends[i] : ends[i + 1]].tobytes()
                self._put(key, out[key])
        return out


def _ids_of_words(words: WordEncoder, some: list[bytes]) -> bytes:
    return b"".join([words.word(w.decode()) for w in some])


def repaired_join(words: WordEncoder, left: bytes, right: bytes, left_ids: bytes, right_ids: bytes) -> tuple[int, bytes, int] | None:
    """Across a join: bytes of the left ids that stay, the ids between, bytes of the right ids that go.

    The library re-encodes the word at the cut with some words on both sides. At
    those outer words the result must have the same ids as the chunks; if not,
    twice as many are taken. None if the chunks run out of words.
    """
    reach = 1
    while reach < LEAST_WORDS // 2:
        a, b = left.rsplit(None, reach + 1)[-reach - 1 :], right.split(None, reach + 1)[: reach + 1]
        inner_left = b"" if left[-1:].isspace() else a.pop()
        inner_right = b"" if right[:1].isspace() else b.pop(0)
        window = b" ".join([*a, inner_left + inner_right, *b]).decode()
        ids = np.array(words.tokenizer.encode(window, add_special_tokens=False).ids, "<u2").tobytes()
        outer_left, outer_right = _ids_of_words(words, a), _ids_of_words(words, b)
        cut_left, cut_right = _ids_of_words(words, inner_left.split()), _ids_of_words(words, inner_right.split())
        agrees = ids.startswith(outer_left) and ids.endswith(outer_right) and len(ids) >= len(outer_left) + len(outer_right)
        if agrees and left_ids.endswith(outer_left + cut_left) and right_ids.startswith(cut_right + outer_right):
            return len(left_ids) - len(cut_left), ids[len(outer_left) : len(ids) - len(outer_right)], len(cut_right)
        reach *= 2
    return None


def encode_slice(store: ChunkStore, texts: list[str | None]) -> list[np.ndarray]:
    """Ids of each text."""
    datas = [(t or "").encode() for t in texts]
    places = [cut_places(d) for d in datas]
    pieces = [[d[low:high] for low, high in zip(p[:-1], p[1:], strict=True)] for d, p in zip(datas, places, strict=True)]
    keys = [[xxhash.xxh3_128_digest(c) for c in p] for p in pieces]
    known = store.ids_of({k: c for p, ks in zip(pieces, keys, strict=True) for c, k in zip(p, ks, strict=True)})
    out = []
    for data, chunks, ks in zip(datas, pieces, keys, strict=True):
        coded, parts, low = [known[k] for k in ks], [], 0
        for i in range(len(chunks) - 1):
            join = repaired_join(store.words, chunks[i], chunks[i + 1], coded[i], coded[i + 1])
            if join is None:
                whole = store.words.tokenizer.encode(data.decode(), add_special_tokens=False).ids
                parts, low, coded = [np.array(whole, "<u2").tobytes()], 0, [b""]
                break
            parts += [coded[i][low : join[0]], join[1]]
            low = join[2]
        parts.append(coded[-1][low:])
        out.append(np.frombuffer(b"".join(parts), "<u2"))
    return out


class Decoder:
    """The library's decode() without a decoder model: the ids' strings, joined by a space."""

    def __init__(self, words: WordEncoder):
        if words.tokenizer.decoder is not None:
            raise ValueError("this vocabulary has a decoder of its own")
        self.strings = [words.tokenizer.id_to_token(i) for i in range(words.size)]
        self.numbers = [str(i) for i in range(words.size)]

    def text(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])

    def decimals(self, ids: list[int]) -> str:
        return " ".join([self.numbers[i] for i in ids])


@lru_cache(maxsize=2)
def _tools(path: str) -> tuple[ChunkStore, Decoder]:
    words = encoder(path)
    return ChunkStore(words), Decoder(words)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode every row: ``<id_col>, n_tokens, ids_sha256, decoded_sha256``.

    ``ids_sha256`` is over the decimal ids joined by a space, ``decoded_sha256``
    over the decoded text. ``with_ids`` adds ``ids`` and ``decoded``. Null text is
    empty. Ids may be null or repeat; each row gives a row. Other columns are not
    looked at. Nothing is shuffled: a chunk is encoded once by each worker that
    meets it, while it is in the worker's bounded store.
    """
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, decoder = _tools(vocabulary)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for whole in batches:
            for batch in slices(whole, "text", 1_000_000):
                n, first, second, ids, texts = [], [], [], [], []
                for found in encode_slice(store, batch.column("text").to_pylist()):
                    some = found.tolist()
                    text = decoder.text(some)
                    n.append(len(some))
                    first.append(digest(decoder.decimals(some)))
                    second.append(digest(text))
                    ids.append(some if with_ids else None)
                    texts.append(text if with_ids else None)
                columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.record_batch(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    out = rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string")
    return out if with_ids else out.drop("ids", "decoded")
