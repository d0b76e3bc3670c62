import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.llm import caps

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=caps.COSINE):
    """n_links and component of every row, by its place."""
    dims = max([len(v) for _, v, _ in rows if v] + [1])
    good = [bool(v) and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    m = np.zeros((len(rows), dims))
    for i, (_, v, _) in enumerate(rows):
        if good[i]:
            m[i, : len(v)] = np.array(v, np.float32)
            m[i] /= np.linalg.norm(m[i])
    labels = np.array([-1 if l is None else l for _, _, l in rows])
    linked = (m @ m.T >= cosine) & (labels[:, None] == labels[None, :]) & np.outer(good, good)
    np.fill_diagonal(linked, False)
    least = [2**60 if i is None else i for i, _, _ in rows]
    while True:
        new = [min([least[i], *(least[j] for j in np.flatnonzero(linked[i]))]) for i in range(len(rows))]
        if new == least:
            break
        least = new
    least = [None if i == 2**60 else i for i in least]
    return [(r[0], int(linked[i].sum()), least[i], least[i] is None or r[0] == least[i]) for i, r in enumerate(rows)]


def turned(rng, base, cosine):
    """A unit vector at the given cosine to ``base``."""
    x = rng.standard_normal(len(base))
    x -= x @ base * base
    return cosine * base + math.sqrt(1 - cosine**2) * x / np.linalg.norm(x)


@pytest.fixture(scope="module")
def rows():
    """Dense and loose spots, chains, scaled and equal copies, and strangers, in 24 dimensions."""
    rng, out = np.random.default_rng(3), []
    unit = lambda: (x := rng.standard_normal(24)) / np.linalg.norm(x)
    for label in (0, 1):
        for spread in (0.999, 0.99, 0.975, 0.965, 0.95):
            base = unit()
            out += [(turned(rng, base, rng.uniform(spread, 1)), label) for _ in range(60)]
        x = unit()
        for _ in range(30):
            x = turned(rng, x, 0.9301 + 0.01 * rng.random())
            out.append((x, label))
        out += [(unit(), label) for _ in range(100)]
        base = unit()
        out += [(base, label), (base, label), (base, label), (3 * base, label), (-base, label), (base, 1 - label)]
    order = rng.permutation(len(out))
    made = [(int(i), [float(c) for c in out[i][0].astype(np.float32)], out[i][1]) for i in order]
    odd = [
        (None, made[0][1], made[0][2]), (5, made[1][1], made[1][2]), (9000, None, 0), (9001, [0.0] * 24, 0), (9002, [1.0, None, 2.0], 0),
        (9003, [float("nan")] + [1.0] * 23, 0), (9004, [float("inf")] + [1.0] * 23, 0), (9005, made[2][1], None), (9006, [], 1), (9007, [1.0], 1),
        (9008, [2.0], 1), (None, None, None), (9009, [1e38] * 24, 1), (9010, [1e-38] * 24, 1),
    ]
    return made + odd


def test_equals_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(caps, "TILE", 7)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in ("id", "node", "ball", "filter", "unit", "weight", "n")})
    # In 24 dimensions two of 34,000 links are missed with 32 filters a vector, none with twice as many.
    got = sorted(map(str, map(tuple, caps.near_vectors(table, passed=96).collect())))
    want = brute(rows)
    assert got == sorted(map(str, want))
    assert sum(w[1] for w in want) > 5000 and len({w[2] for w in want}) > 100


def test_empty_tables(spark):
    assert caps.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = spark.createDataFrame([(1, None, 1), (2, [0.0], 1), (None, [1.0], None)], SCHEMA)
    assert {tuple(r) for r in caps.near_vectors(nothing).collect()} == {(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)}


def test_pairs_at_the_least_cosine_share_a_filter():
    rng = np.random.default_rng(8)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = np.array([turned(rng, x, caps.COSINE) for x in a])
    code = caps.Code(64)
    mine, theirs = [set(zip(*map(np.ndarray.tolist, caps.filters_of(v, code)), strict=True)) for v in (a, b)]
    assert len({row for row, _ in mine & theirs}) >= 0.998 * len(a)
    assert 0.5 * caps.PASSED < len(mine) / len(a) < 2 * caps.PASSED


def test_all_filters_above_the_height_are_listed():
    rng = np.random.default_rng(4)
    v = rng.standard_normal((40, 12))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    code = caps.Code(12, rotations=2, blocks=3, words=8, passed=20)
    tables, height = caps._drawn(code)
    for turn, words in tables:
        want = set()
        sides = (v @ turn).reshape(len(v), 3, -1)
        for i in range(len(v)):
            sums = {a * 64 + b * 8 + c: sides[i, 0] @ words[0, a] + sides[i, 1] @ words[1, b] + sides[i, 2] @ words[2, c] for a in range(8) for b in range(8) for c in range(8)}
            want |= {(i, k) for k, s in sums.items() if s >= min(height, max(sums.values()))}
        assert set(zip(*map(np.ndarray.tolist, caps._listed(v, turn, words, height)), strict=True)) == want


def test_a_dense_spot_is_few_balls(spark):
    """Near copies in any number meet a few balls and not one another."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal(64)
    base /= np.linalg.norm(base)
    rows = [(i, [float(c) for c in turned(rng, base, 0.995).astype(np.float32)], 1) for i in range(800)]
    found = {}
    before = caps.materialize

    def watched(df, label):
        found[label] = before(df, label)
        return found[label]

    caps.materialize = watched
    try:
        got = caps.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        caps.materialize = before
    assert {(r["n_links"], r["component_id"]) for r in got} == {(799, 0)}
    assert found["caps-balls"].count() < 60 and found["caps-pairwise"].count() < 8000
