import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tapewright.llm import bpe, chunks, rans

LETTERS = "abcXYZ é̂ÀßİıſK'’0９٣ \t\n\x0b\x1c\x85\xa0 <|startoftext|>end,.!?#\"ς Σ中文🎉́ñÿ÷×µªº¼      "


@pytest.fixture(scope="module")
def words():
    return bpe.WordEncoder(bpe.default_vocabulary())


def strange(n, most):
    rnd = random.Random(n)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def test_word_encoder_equals_the_library(words):
    texts = [*strange(2000, 60), None, "", "a<|endoftext|>b", "<|STARTOFTEXT|>", "I'LL don't 'Sx", "Word,word.Word"]
    for some in (texts, [t for t in texts if "<|" not in (t or "")]):
        ids, ends = words.encode(pa.array(some).slice(3))
        for i, t in enumerate(some[3:]):
            assert ids[ends[i] : ends[i + 1]].tolist() == words.tokenizer.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_word_encoder_on_any_text(text):
    enc = bpe.encoder(bpe.default_vocabulary())
    ids, _ = enc.encode(pa.array([text]))
    assert ids.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [3, 9])
def test_chunks_equal_the_library(words, bits, monkeypatch):
    monkeypatch.setattr(chunks, "BITS", bits)
    texts = [*strange(300, 1500), "a" * 5000, "a<|endoftext|>b " * 300, None, "", " \n" * 2000]
    store, decoder = chunks.ChunkStore(words), chunks.Decoder(words)
    for _ in range(2):
        for t, found in zip(texts, chunks.encode_slice(store, texts), strict=True):
            ids = words.tokenizer.encode(t or "", add_special_tokens=False).ids
            assert found.tolist() == ids
            assert decoder.text(ids) == words.tokenizer.decode(ids, skip_special_tokens=False)
    assert store.reused >= store.encoded > len(texts) / 2


def test_cuts_depend_on_content_only():
    body = " ".join(strange(200, 30)).encode()
    places = [c + 7 for c in chunks.cut_places(body)[3:-3]]
    assert set(places) <= set(chunks.cut_places(b"before " + body))


def test_round_trip(odd_docs, no_docs):
    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(tokenizer.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in chunks.round_trip(odd_docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert chunks.round_trip(no_docs).count() == 0


@pytest.mark.parametrize("n", [0, 1, 15, 17, 5000, 140_000])
def test_rans_round_trip(n):
    draw = np.minimum(np.random.default_rng(n).zipf(1.3, n), 49_999)
    coder = rans.Coder(rans.scaled_frequencies(np.bincount(draw, minlength=50_000) + (np.arange(50_000) == 7)))
    for lanes in (16, rans.LANES):
        words_, states, places = coder.encode(draw, lanes)
        assert np.array_equal(coder.decode(n, words_, states, places, lanes), draw)
        for first in range(len(places) // 8):
            assert np.array_equal(coder.decode(n, words_, states, places, lanes, first), draw[first * rans.CHECKPOINT * lanes :])


def test_frequencies():
    counts = np.array([0, 1, 10**12, 5, 0])
    scaled = rans.scaled_frequencies(counts)
    assert scaled.sum() == 1 << rans.SCALE
    assert ((scaled > 0) == (counts > 0)).all()


def test_token_files(spark, odd_docs, no_docs, tmp_path):
    tokenizer = Tokenizer.from_file(bpe.default_vocabulary())
    rows = sorted(((r["doc_id"], r["text"]) for r in odd_docs.collect() if r["doc_id"] is not None), key=lambda r: r[0])
    path = str(tmp_path / "files")
    rans.write_token_files(odd_docs.where("doc_id is not null"), path)
    got = sorted(map(tuple, rans.read_token_files(spark, path).collect()), key=lambda r: r[1])
    start = 0
    for (i, text), found in zip(rows, got, strict=True):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert found == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert rans.coded(odd_docs).where("doc_id is null").count() == 2
    assert rans.coded(no_docs).count() == 0


def test_damage_is_found():
    coder_table = rans.scaled_frequencies(np.ones(10, np.int64)).astype("<u8").tobytes()
    ids = np.arange(10).repeat(30)
    words_, states, places = rans.Coder(np.frombuffer(coder_table, "<u8")).encode(ids, 16)
    row = {"part": 0, "block": 0, "n_ids": 300, "doc_ids": b"", "doc_lengths": b"", "lanes": 16, "words": words_, "states": states, "places": places, "checksum": 1}
    with pytest.raises(ValueError, match="damaged"):
        list(rans.decoded_blocks([pa.RecordBatch.from_pylist([row], schema=rans._ARROW)], coder_table))
