"""Batch encoding with a public BPE vocabulary.

The vocabulary drops white space and none of its patterns spans it, so the ids
of a text are the ids of its words (runs between ASCII white space) in order.
Words repeat: each worker encodes a word with the tokenizers library when it
first meets it and then reuses the ids. Known words and their ids are Arrow arrays,
so that words are looked up and ids gathered for a whole batch at a time.
:meth:`WordEncoder.encode` turns an Arrow batch of texts into one flat array of
ids and the documents' offsets.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Known words beyond which a worker goes on with those of the last slice alone.
WORDS_KEPT = 1_000_000
#: Words that a worker keeps in each of the two generations of :meth:`WordEncoder.word`.
SINGLES_KEPT = 50_000
#: Longer words are encoded each time they occur.
LONGEST_KEPT = 64
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 8_000_000

#: Letters whose lower-casing and composition are the same in Python and in the library.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+\Z")
#: The vocabulary's own splitting pattern over those letters (fixed value of the file).
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\sa-z0-9à-öø-ÿß]+")
_LETTERS = "^[a-zß-öø-ÿ]+$"
_SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_vocabulary() -> str:
    """Path of the 49k-word vocabulary in the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable letter; bytes without one take letters from 256 up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b if b in printable else next(spare)) for b in range(256)}


class WordEncoder:
    """Encodes batches of texts; exact for every text."""

    def __init__(self, path: str):
        import json

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splits = [p.get("pattern", {}).get("Regex") for p in spec["pre_tokenizer"].get("pretokenizers", [])]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if splits[:1] != [_SPLIT_PATTERN] or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("this encoder is for vocabularies that lower-case and drop white space")
        self.size = self.tokenizer.get_vocab_size()
        self.special = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        letters = _byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(33, 256)}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.known = pa.array([], pa.large_string())
        self.coded = pa.array([], pa.large_list(pa.uint16()))

    def _fresh(self, word: str) -> bytes:
        """Ids of a word that is met for the first time."""
        if _PLAIN.match(word) and "<|" not in word:
            tokenize, letters = self.model.tokenize, self.letters
            ids = [t.id for p in _PIECES.findall(word.lower()) for t in tokenize(p.translate(letters))]
            return struct.pack(f"<{len(ids)}H", *ids)
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u2").tobytes()

    def word(self, word: str) -> bytes:
        ids = self.young.get(word)
        if ids is None:
            ids = self.old.get(word)
            if ids is None:
                ids = self._fresh(word)
            if len(word) <= LONGEST_KEPT:
                if len(self.young) >= SINGLES_KEPT:
                    self.old, self.young = self.young, {}
                self.young[word] = ids
        return ids

    def _ids_of(self, words: pa.Array) -> pa.Array:
        """Ids of words that are met for the first time, a list each."""
        tokenize, letters, flat, ends = self.model.tokenize, self.letters, [], [0]
        # Lower-case letters alone are one piece of the splitting pattern.
        for word, simple in zip(words.to_pylist(), pc.match_substring_regex(words, _LETTERS).to_pylist(), strict=True):
            if simple:
                flat += [t.id for t in tokenize(word if word.isascii() else word.translate(letters))]
            else:
                flat += np.frombuffer(self._fresh(word), "<u2").tolist()
            ends.append(len(flat))
        return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat, pa.uint16()))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) as uint16, and the offsets of the texts in them."""
        # take() makes a compact copy: some string kernels misread the offset of a sliced array.
        texts = pc.fill_null(texts, "").cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            # Fewer distinct words: "The", "the" and the word in "the," share their ids. Special
            # tokens are matched before lower-casing, so texts that may hold one stay as they are.
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,])", r"\1 \2")
        words = pc.ascii_split_whitespace(texts)
        bounds = np.asarray(words.offsets)
        words, bounds = words.values.slice(bounds[0], bounds[-1] - bounds[0]), bounds - bounds[0]
        which = pc.index_in(words, value_set=self.known)
        known, coded = self.known, self.coded
        if which.null_count:
            new = words.filter(pc.is_null(which))
            fresh = new.unique()
            which = pc.replace_with_mask(which, pc.is_null(which), pc.add(pc.index_in(new, value_set=fresh), pa.scalar(len(known), pa.int32())))
            known, coded = pa.concat_arrays([known, fresh]), pa.concat_arrays([coded, self._ids_of(fresh)])
            kept = which.unique() if len(known) > WORDS_KEPT else pa.array(np.arange(len(known)))
            small = pc.less_equal(pc.utf8_length(known.take(kept)), LONGEST_KEPT)
            whole = len(kept) == len(known) and pc.all(small).as_py()
            self.known, self.coded = (known, coded) if whole else (known.take(kept.filter(small)), coded.take(kept.filter(small)))
        found = coded.take(which)
        ends = np.asarray(found.offsets)
        ids = np.asarray(found.values)[ends[0] : ends[-1]] if len(found) else np.empty(0, np.uint16)
        return ids, (ends - ends[0])[bounds]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary; kept from task to task."""
    return WordEncoder(path)


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``most`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)
