import random
import re

import numpy as np
import pytest

from tapewright.llm import minhash
from tapewright.llm.components import components
from tapewright.llm.shingles import shingle_set

from .conftest import prose, rows_of

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_sets(text, k):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain_components(rows, k, percent):
    sets, parent = {}, {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(plain_sets(t, k))
            parent[i] = i

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def family(spark):
    """A base, copies with few and with many changes, chains of changes, and strangers."""
    rnd, texts = random.Random(9), []
    for base in range(3):
        words = prose(base, 90).split()
        for _ in range(40):
            new = list(words)
            for _ in range(rnd.randint(0, 14)):
                new[rnd.randrange(len(new))] = rnd.choice(["alpha", "beta", "gamma", "delta", "eps"])
            texts.append(" ".join(new))
        chain = list(words)
        for _ in range(8):
            for _ in range(4):
                chain[rnd.randrange(len(chain))] = prose(rnd.randrange(10**6), 1)
            texts.append(" ".join(chain))
    texts += [prose(100 + i, 60) for i in range(20)]
    rnd.shuffle(texts)
    return spark.createDataFrame(rows_of(texts), "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("k", [2, 5])
def test_family_equals_brute_force(family, k):
    want = plain_components([(r["doc_id"], r["text"]) for r in family.collect()], k, 80)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(family, k=k).collect()}
    assert got == want
    assert len(set(want.values())) > 30


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = plain_components(rows, 2, 80)
    for r in minhash.near_duplicates(odd_docs, k=2).collect():
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
        assert r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])
    kept = minhash.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == {i for i, c in plain_components(rows, 5, 80).items() if i == c}
    assert minhash.near_duplicates(no_docs).count() == 0


def test_signature_estimates_similarity():
    words = prose(7, 2000).split()
    a, b = shingle_set(" ".join(words[:1500]), 3), shingle_set(" ".join(words[300:1800]), 3)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = minhash.min_max_signature(a) == minhash.min_max_signature(b)
    assert abs(same.mean() - true) < 0.1


def test_miss_probability():
    bands = 2 * minhash.FUNCTIONS // minhash.ROWS
    assert (1 - 0.8**minhash.ROWS) ** bands < 2e-8


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)] + [(5000, 5000)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for e in edges for i in e if e[0] != e[1]}


def test_texts_of_one_id_are_one_document(spark):
    a, b, c = prose(71, 60), prose(72, 60), prose(73, 60)
    docs = spark.createDataFrame(rows_of([a]), "doc_id long, text string, lang string, source string, n_chars long").limit(0)
    rows = [(5, a), (5, b), (1, a), (2, b), (9, c), (9, c), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(5, 1, False), (1, 1, True), (2, 1, False), (9, 9, True), (7, 7, True)}
