import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tapewright.llm import packing
from tapewright.llm.bpe import default_vocabulary

from .conftest import prose, rows_of


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), min_size=1, max_size=6), st.data())
def test_schedule_uses_every_id_once(totals, data):
    weights = data.draw(st.none() | st.lists(st.integers(0, 50), min_size=len(totals), max_size=len(totals)))
    runs = packing.schedule(totals, weights, 256)
    taken = defaultdict(list)
    for q, n in enumerate(totals):
        at = 0
        while at < n:
            size = min(n - at, 97)
            pieces = list(packing.cuts(runs, q, at, size))
            assert sum(p[1] for p in pieces) == size
            for _, length, sequence, offset in pieces:
                taken[sequence].append((offset, length))
            at += size
    used = [sum(x[1] for x in taken[s]) for s in range(len(taken))]
    assert used[:-1] == [256] * (len(used) - 1)
    assert sum(used) == sum(totals)
    for pieces in taken.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length


def test_shares_hold_in_every_sequence():
    runs = packing.schedule([300_000, 100_000, 50_000], None, 2048)
    for t in range(0, runs[0].count, 7):
        takes = [runs[0].start(q, t + 1) - runs[0].start(q, t) for q in range(3)]
        assert sum(takes) == 2048
        assert all(abs(n - 2048 * share) < 2 for n, share in zip(takes, (6 / 9, 2 / 9, 1 / 9), strict=True))


@pytest.mark.parametrize("mixture", [None, {"s1": 3, "s2": 1, "": 1}])
def test_pieces(spark, odd_docs, odd_texts, mixture):
    tokenizer = Tokenizer.from_file(default_vocabulary())
    docs = spark.createDataFrame(rows_of([*odd_texts, *[prose(i, 900) for i in range(30)]]), "doc_id long, text string, lang string, source string, n_chars long")
    ids = {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, mixture=mixture).collect():
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == ids.keys()
    for i, pieces in by_doc.items():
        end = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (end, len(ids[i]))
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[i][end : end + r["length"]], "<u4").tobytes())
            end += r["length"]
        assert end == len(ids[i])
    sizes = {s: sum(r["length"] for r in p) for s, p in by_sequence.items()}
    assert all(sizes[s] == 2048 for s in range(max(sizes)))


def test_odd_rows(odd_docs, no_docs):
    found = packing.pack(odd_docs, with_ids=True).collect()
    assert sum(r["start"] == 0 for r in found) == odd_docs.count()
    assert all(len(r["ids"]) == 4 * r["length"] for r in found)
    assert packing.pack(no_docs).count() == 0


def test_sequences_keep_the_shares(spark):
    """Sources of their own and small ones that share a queue: gapless sequences, each with the corpus's shares."""
    texts = [prose(i, 60) for i in range(1500)]
    source = lambda i: "big" if i % 2 else "mid" if i % 4 else f"small{i % 125}"
    docs = spark.createDataFrame([(i, t, "en", source(i), len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    rows = packing.pack(docs).collect()
    totals, by_sequence = defaultdict(int), defaultdict(list)
    for r in rows:
        kind = source(r["doc_id"])[:3]
        totals[kind] += r["length"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"], kind))
    assert set(by_sequence) == set(range(len(by_sequence)))
    whole = sum(totals.values())
    for number, pieces in by_sequence.items():
        end = 0
        for offset, length, _ in sorted(pieces):
            assert offset == end
            end += length
        if number < len(by_sequence) - 1:
            assert end == 2048
            for kind in totals:
                assert abs(sum(n for _, n, k in pieces if k == kind) - 2048 * totals[kind] / whole) < 2
    # In the shared queue each small source is spread over the whole, not packed end to end.
    first_half = [r for r in rows if source(r["doc_id"]).startswith("small") and r["sequence_id"] < len(by_sequence) / 2]
    assert len({source(r["doc_id"]) for r in first_half}) == len({source(i) for i in range(1500) if source(i).startswith("small")})


def test_a_mixture_names_its_queues(spark):
    docs = spark.createDataFrame([(i, prose(i, 300), "en", ("a", "a", "a", "b")[i % 4] if i < 400 else "tiny", 1) for i in range(401)], "doc_id long, text string, lang string, source string, n_chars long")
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken = defaultdict(lambda: defaultdict(int))
    for r in packing.pack(docs, mixture={"a": 1, "b": 1}).collect():
        taken[r["sequence_id"]][source[r["doc_id"]]] += r["length"]
    assert all(abs(taken[s]["a"] - taken[s]["b"]) <= 2 for s in range(1, 20))


def plain_round_robin(totals, weights, size):
    """Ids of each queue per sequence, from a loop that carries exact deficits from one sequence to the next."""
    left, owed, out = list(totals), [Fraction(0)] * len(totals), []
    while sum(left):
        room, takes = min(size, sum(left)), [0] * len(left)
        while room:
            alive = [q for q in range(len(left)) if left[q] and weights[q]]
            share = weights if alive else list(left)
            alive = alive or [q for q in range(len(left)) if left[q]]
            part = room
            for q in alive:
                owed[q] += Fraction(part * share[q], sum(share[k] for k in alive))
            for q in sorted(alive, key=lambda q: -owed[q]):
                take = max(0, min(int(owed[q]), left[q], room))
                takes[q], left[q], owed[q], room = takes[q] + take, left[q] - take, owed[q] - take, room - take
            if room == part or (0 < room < len(alive)):
                q = max((q for q in alive if left[q]), key=lambda q: owed[q], default=None)
                if q is not None:
                    takes[q], left[q], owed[q], room = takes[q] + 1, left[q] - 1, owed[q] - 1, room - 1
        out.append(takes)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4000), min_size=1, max_size=5), st.data())
def test_schedule_follows_a_plain_round_robin(totals, data):
    """Until a queue runs dry, the running sums of both stay within the ids that rounding can owe."""
    weights = data.draw(st.lists(st.integers(0, 9), min_size=len(totals), max_size=len(totals)).filter(any))
    runs, plain = packing.schedule(totals, weights, 128), plain_round_robin(totals, weights, 128)
    assert sum(r.count for r in runs) == len(plain)
    given_out = [[r.start(q, t + 1) - r.start(q, t) for q in range(len(totals))] for r in runs for t in range(r.count)]
    ours, theirs = np.cumsum(given_out, axis=0), np.cumsum(plain, axis=0)
    for a, b in zip(ours, theirs, strict=True):
        if any(n >= total - len(totals) for n, total, w in zip(b, totals, weights, strict=True) if w):
            break
        assert max(abs(a - b)) <= len(totals)
        assert all(n == 0 for n, w in zip(a, weights, strict=True) if not w)


def test_weights_hold_whatever_their_size():
    run = packing.schedule([100_000, 100_000, 100_000], [3, 1, 0], 2048)[0]
    assert [run.start(q, 1) for q in range(3)] == [1536, 512, 0]
    with pytest.raises(ValueError, match="negative"):
        packing.schedule([5, 5], [1, -1])


@pytest.mark.parametrize(("mixture", "shares"), [({"a": 3, "b": 1}, (1536, 512, 0)), ({"a": 2, "b": 1, "": 1}, (1024, 512, 512))])
def test_unnamed_sources(spark, mixture, shares):
    """Sources c and d are named by no key: without '' they wait, with it they have its weight together."""
    docs = spark.createDataFrame([(i, prose(i, 300), "en", "abcd"[i % 4], 1) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    taken = defaultdict(lambda: defaultdict(int))
    for r in packing.pack(docs, mixture=mixture).collect():
        taken[r["sequence_id"]]["abcd"[r["doc_id"] % 4]] += r["length"]
    for s in range(15):
        found = (taken[s]["a"], taken[s]["b"], taken[s]["c"] + taken[s]["d"])
        assert sum(found) == 2048
        assert all(abs(n - share) <= 1 for n, share in zip(found, shares, strict=True))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3000), min_size=1, max_size=8), st.data())
def test_queues_never_go_back(totals, data):
    weights = data.draw(st.none() | st.lists(st.sampled_from([0, 1, 2, 300, 70_000]), min_size=len(totals), max_size=len(totals)))
    for r in packing.schedule(totals, weights, 64):
        for q in range(len(totals)):
            places = [r.start(q, t) for t in range(r.count + 1)]
            assert places == sorted(places)
            assert places[-1] <= totals[q]
