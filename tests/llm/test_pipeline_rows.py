"""Every stage on odd rows: nulls, ties, repeats, long and empty texts, extra columns, no rows at all."""

import pytest

import corpus_pipeline


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_rows(spark, odd_docs, no_docs, name, stage):
    rows = stage(spark, odd_docs, "").collect()
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd_docs.collect()}
        assert sum(r["start"] == 0 for r in rows) == odd_docs.count()
    else:
        assert list(rows[0].asDict()) == corpus_pipeline.COLUMNS
        known = {(r["doc_id"], r["lang"], r["source"]) for r in odd_docs.collect()}
        assert {(r["doc_id"], r["lang"], r["source"]) for r in rows} <= known
    assert stage(spark, no_docs, "").count() == 0


def test_what_stays(spark, odd_docs):
    stages = dict(corpus_pipeline.STAGES)
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    kept = [(r["doc_id"], r["text"]) for r in stages["exact dedup"](spark, odd_docs, "").collect()]
    assert len(kept) == len(set(kept)) == len({t or "" for t in [*texts.values(), "text without an id"]})
    near = [r["doc_id"] for r in stages["near dedup"](spark, odd_docs, "").collect()]
    assert {None, 0, 1, 2, 6} <= set(near) and not {7, 8, 9} & set(near)
    cut = {r["doc_id"]: r["text"] for r in stages["substring dedup"](spark, odd_docs, "").collect() if r["doc_id"] is not None}
    assert cut[6] == texts[6] and cut[0] is None and cut[1] == ""
    assert len(cut[13].split()) == 60
