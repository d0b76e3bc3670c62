import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapewright.llm import middle

from .conftest import prose, rows_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(doc_id, text, rate=100, spm_rate=50):
    """n, form, prefix, middle and output by the definition."""
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, mid, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm_rate:
        return n, "spm", len(prefix), len(mid), f"<S>{suffix}<P>{prefix}<M>{mid}"
    return n, "psm", len(prefix), len(mid), f"<P>{prefix}<S>{suffix}<M>{mid}"


def lines(seed, n):
    words = prose(seed, 5 * n).split()
    return "\n".join(" ".join(words[5 * i : 5 * i + 5]) for i in range(n))


@pytest.fixture(scope="module")
def docs(spark, odd_texts):
    texts = [*odd_texts, "\n", "\n\n", "a\n", "\nb", "a\n\nb\n", "x<P>", "<S>\ny", "a<M>\n", "<P", "P>", "<", ">", "S>a\nb<", "<P\n>", "a<\nP>\nb", "é\n中\n🎉", lines(5, 40)]
    texts += [lines(100 + i, 3 + i % 17) + "\n" * (i % 3) for i in range(120)]
    rows = rows_of(texts)
    return spark.createDataFrame([*rows, rows[3], (None, "no\nid\nhere", None, None, None), (None, None, None, None, None)], SCHEMA)


@pytest.mark.parametrize(("rate", "spm_rate"), [(100, 50), (40, 0), (100, 100)])
def test_equals_the_definition(docs, rate, spm_rate):
    got = sorted(middle.fill_in_middle(docs, rate=rate, spm_rate=spm_rate).collect(), key=str)
    want = sorted([(r["doc_id"], *plain(r["doc_id"], r["text"], rate, spm_rate)) for r in docs.collect()], key=lambda r: str(r))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r["form"] for r in got} >= ({"plain", "psm", "spm"} if (rate, spm_rate) == (100, 50) else {"plain"})


def test_restored_from_output_and_form(docs):
    made = middle.fill_in_middle(docs)
    back = {(r["doc_id"], r["text"]) for r in middle.restore_text(made).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in docs.collect()}


def test_digests(docs):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r["doc_id"]: (r["output_sha256"], r["restored_sha256"]) for r in middle.digests(docs).collect() if r["doc_id"] is not None}
    for r in docs.collect():
        if r["doc_id"] is not None:
            assert got[r["doc_id"]] == (sha(plain(r["doc_id"], r["text"])[-1]), sha(r["text"] or ""))


def test_long_text_and_small_steps(spark, monkeypatch):
    """Texts longer than a part of a batch, and displacements that are carried from step to step."""
    text = lines(77, 60_000) + "\nno break at the end 🎉"
    assert len(text) > middle._SLICE // 2
    made = middle.fill_in_middle(spark.createDataFrame(rows_of([text + text, "short", text]), SCHEMA))
    for r in middle.restore_text(made).collect():
        whole = [text + text, "short", text][r["doc_id"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["text"]) == (*plain(r["doc_id"], whole), whole)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab\n<PSM>é🎉", max_size=30), min_size=1, max_size=8), st.integers(1, 40), st.randoms(use_true_random=False))
def test_any_batch(texts, step, rnd):
    import numpy as np

    h = [np.array([rnd.randrange(2**32) for _ in texts]) for _ in range(4)]
    before, middle._STEP = middle._STEP, step
    try:
        made = middle.rearranged(pa.array(texts), h)
        assert middle.rebuilt(made.column("output"), made.column("form")).to_pylist() == texts
    finally:
        middle._STEP = before
    for i, text in enumerate(texts):
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        a, b = sorted(int(h[j][i]) % (len(units) + 1) for j in range(2))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}
        form = made.column("form")[i].as_py()
        assert made.column("output")[i].as_py() == want[form]
        assert made.column("n")[i].as_py() == len(units)
        if form != "plain":
            assert (made.column("prefix_chars")[i].as_py(), made.column("middle_chars")[i].as_py()) == (len(p), len(m))


def test_empty_table_and_clashing_names(odd_docs, no_docs):
    assert middle.digests(no_docs).count() == 0
    got = middle.fill_in_middle(odd_docs.withColumnsRenamed({"body": "output", "tag": "form", "h": "h0"}))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert got.count() == odd_docs.count()
