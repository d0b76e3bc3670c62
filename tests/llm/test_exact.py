from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tapewright.llm import exact


def expected(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max(known) if keep == "max" else min(known)) if known else None
        for n, i in enumerate(sorted(ids, key=lambda i: i != best)):
            out[(i, best, len(ids), n == 0, sha256(text.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("hash_fn", [exact.content_hash, lambda c: F.lit(b"x"), lambda c: F.substring(exact.content_hash(c), 1, 0)])
def test_groups(odd_docs, keep, hash_fn):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = Counter(tuple(r) for r in exact.exact_groups(odd_docs, keep=keep, hash_fn=hash_fn).collect())
    assert got == expected(rows, keep)


def test_drop_keeps_one_row_of_each_text(odd_docs):
    kept = exact.drop_exact_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r["text"] or "" for r in odd_docs.collect()})


def test_empty(no_docs):
    assert exact.exact_groups(no_docs).count() == 0
    assert exact.drop_exact_copies(no_docs).columns == no_docs.columns
