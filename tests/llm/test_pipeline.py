"""The pipeline against plain Python, stage by stage on its own input."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tapewright.llm import passages
from tapewright.llm.bpe import default_vocabulary

from .conftest import prose, rows_of
from .test_minhash import plain_components


def test_stages(spark, tmp_path):
    base = prose(1, 150)
    near = base.split()
    near[70] = "other"
    texts = [base, base, " ".join(near), prose(2, 80) + " " + prose(3, 60), prose(4, 40) + " " + prose(3, 60), prose(5, 90), "short", None, "### %% && " * 60, prose(6, 30) * 3]
    docs = spark.createDataFrame(rows_of(texts), "doc_id long, text string, lang string, source string, n_chars long")
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        outs.append({r["doc_id"]: r["text"] for r in docs.collect()} if name != "packing" else docs.collect())
    rules, exact, near_kept, cut, pieces = outs
    assert {0, 1, 2, 3, 4, 5} <= rules.keys() and not {6, 7} & rules.keys()
    assert exact.keys() == rules.keys() - {1}
    assert near_kept.keys() == {i for i, c in plain_components(list(exact.items()), 5, 80).items() if i == c}
    assert 2 not in near_kept
    assert cut.keys() == near_kept.keys()
    assert cut[4] == passages.without(near_kept[4], [(40, 100)])
    assert all(cut[i] == near_kept[i] for i in cut if i != 4)
    tokenizer = Tokenizer.from_file(default_vocabulary())
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in cut.items()}
    assert sum(r["length"] for r in pieces) == sum(map(len, ids.values()))
    for r in pieces:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes())


def test_run(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert found.count() > 0
