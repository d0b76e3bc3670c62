"""Sets of word shingles as sorted arrays of 64-bit hashes, computed inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Word hashes that a worker keeps for reuse.
WORDS_KEPT = 150_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_hashes: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(27))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > WORDS_KEPT:
        _hashes.clear()
    out = np.empty(len(words), np.uint64)
    get, digest = _hashes.get, xxhash.xxh64_intdigest
    for i, w in enumerate(words):
        h = get(w)
        if h is None:
            h = _hashes[w] = digest(w)
        out[i] = h
    return out


def batch_word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (null: none), and the texts' bounds in them; each distinct word is hashed once."""
    # take() makes a compact copy: some string kernels misread the offset of a sliced array.
    texts = pc.fill_null(texts, "").cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    bounds = np.asarray(words.offsets)
    known = words.values[bounds[0] : bounds[-1]].dictionary_encode()
    names = known.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
    which, bounds = np.asarray(known.indices), bounds - bounds[0]
    # White space at an end of a text leaves an empty word there.
    real = np.fromiter(map(len, names), np.int64, len(names))[which] > 0
    return hashes[which[real]], np.concatenate([[0], np.cumsum(real)])[bounds]


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` successive words; nothing for shorter texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mixed(out * _M1 + hashes[j : j + n])
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; a shorter text is one shingle, none without words."""
    hashes = word_hashes(words_of(text))
    if not len(hashes):
        return hashes
    return np.unique(window_hashes(hashes, min(k, len(hashes))))
