import random
import re
from collections import Counter

import numpy as np
from .plain_quality import fit_groups

from tapewright.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    s = text or ""
    w = WORD.findall(s)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    covered = {j for i, v in enumerate(windows) if often[v] > 1 for j in range(i, i + 8)}
    lines = [x for x in s.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in s), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, odd_docs):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab \n\t#%é🎉") for _ in range(rnd.randint(0, 300))) for _ in range(200)]
    texts += ["x " * 400, "p q r s t u v w " * 3 + "z", "\n".join(["same line here"] * 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.base_counts(docs).collect():
        assert tuple(r[c] for c in quality.BASE) == counts(r["text"]), r["text"]
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])


def test_factors():
    draw = np.random.default_rng(0).chisquare(4, 400_000)
    assert abs(quality.chi2_quantile(0.975, 4) - np.quantile(draw, 0.975)) < 0.1
    assert quality.consistency(0.75) > 1 > quality.chi2_cdf(3, 4) > 0


def test_distances_equal_a_plain_computation(spark):
    """The same estimates in numpy, from the same integer vectors."""
    rnd = np.random.default_rng(5)
    rows = []
    for i in range(900):
        n = int(rnd.integers(30, 400))
        odd = i % 30 == 0
        rows.append((i, ["en", "de"][i % 2], "big" if i % 3 else f"s{i % 60}", False, n, n * 5 + int(rnd.integers(-n // 2, n // 2)), int(n * rnd.uniform(0.3, 0.6)) if odd else int(rnd.integers(0, 3)), int(rnd.integers(0, 2)), 0))
    stats = spark.createDataFrame(rows, "row long, lang string, source string, base_failed boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    got = {r["row"]: r["d2"] for r in quality.outlier_distances(stats).collect()}
    want = fit_groups(rows)
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) <= 1e-6 * (1 + want[i]) for i in want)
    assert all((got[i] > quality.CUTOFF) == (i % 30 == 0) for i in want)


def test_verdicts_and_stage(odd_docs, no_docs):
    found = quality.quality_verdicts(odd_docs)
    assert found.count() == odd_docs.count()
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in found.collect())
    kept = quality.keep_quality(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == found.where("kept").count()
    assert quality.quality_verdicts(no_docs).count() == 0
    assert quality.keep_quality(no_docs).count() == 0


def test_each_statistic_rejects_by_itself(spark):
    """Outliers in one statistic each, in a group that has hardly any of the last three."""
    rnd = np.random.default_rng(8)
    rows = []
    for i in range(400):
        n = int(rnd.integers(100, 400))
        rows.append([i, "en", "s", False, n, n * 5 + int(rnd.integers(-n // 4, n // 4)), int(i % 20 == 0), int(i % 25 == 0), 9 * int(i % 40 == 0)])
    for k, planted in enumerate(({5: 1600}, {6: 20}, {7: 20}, {8: 60})):
        row = [400 + k, "en", "s", False, 200, 1000, 0, 0, 0]
        for at, v in planted.items():
            row[at] = v
        rows.append(row)
    stats = spark.createDataFrame([tuple(r) for r in rows], "row long, lang string, source string, base_failed boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    gone = {r["row"] for r in quality.outlier_distances(stats).collect() if r["d2"] > quality.CUTOFF}
    assert gone == {400, 401, 402, 403}
