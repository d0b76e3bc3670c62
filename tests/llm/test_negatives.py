import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapewright.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=100, low=80, high=100, k=5):
    """The rows of the result, in exact integers."""
    good = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for n, (a, v, l) in enumerate(good):
        if a % every:
            continue
        scored = sorted((-dot(v, w), i, m == l) for o, (i, w, m) in enumerate(good) if o != n)
        for s, p, _ in [x for x in scored if x[2]][:k]:
            hits = [(t, i) for t, i, same in scored if not same and low * -s <= 100 * -t <= high * -s][:k]
            out += [(a, p, rank + 1, i, -s, -t) for rank, (t, i) in enumerate(hits)]
    return out


@pytest.fixture(scope="module")
def rows():
    """Clusters whose members have several labels, ties, repeated ids and rows, and rows that take no part."""
    rng, out = np.random.default_rng(5), []
    centers = rng.standard_normal((6, 10)) / 2
    for i in range(900):
        v = centers[i % 6] + 0.1 * rng.standard_normal(10)
        out.append((i, [round(float(x), 2) for x in v], int(rng.integers(0, 4)) if i % 5 else 0))
    out += [(i, out[i - 900 + 50][1], 2) for i in range(900, 1000)]
    out += [(300, out[7][1], 1), (300, out[300][1], out[300][2]), (8, out[8][1], out[8][2])]
    out += [
        (None, out[0][1], 0), (2000, None, 0), (2100, [1.0, None], 0), (2200, [float("nan")] * 10, 1), (2300, [float("inf")] * 10, 1), (2400, out[0][1], None),
        (2500, [], 0), (2600, [0.0] * 10, 1), (2700, [0.5], 2), (-100, out[3][1], 3), (2800, [-x for x in out[4][1]], 0),
    ]
    return out


def collected(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("sizes", [(256, 128, 256), (7, 5, 3)])
def test_equals_brute_force(spark, rows, monkeypatch, sizes):
    for name, size in zip(("BLOCK", "TILE", "PAGE"), sizes, strict=True):
        monkeypatch.setattr(negatives, name, size)
    # Workers have modules of their own: sizes reach them with the functions that are sent.
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in ("id", "place", "block", "tile", "page", "score", "rank", "window")})
    got = collected(negatives.mine_negatives(table))
    assert got == sorted(brute(rows))
    assert len(got) > 100


def test_other_windows(spark, rows):
    some = rows[:400]
    got = collected(negatives.mine_negatives(spark.createDataFrame(some, SCHEMA), every=40, low=50, high=95, positives=3, negatives=3))
    assert got == sorted(brute(some, 40, 50, 95, 3))


def test_large_components(spark):
    """Scores beyond the integers that doubles hold."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(2**18, 2**19, 6) / 1.0 + rng.random(6)], i % 3) for i in range(250)]
    assert collected(negatives.mine_negatives(spark.createDataFrame(rows, SCHEMA), every=50)) == sorted(brute(rows, 50))


def test_empty_tables(spark):
    for some in ([], [(100, None, 1)], [(100, [1.0], 1)], [(100, [1.0], 1), (1, [1.0], 1)]):
        assert negatives.mine_negatives(spark.createDataFrame(some, SCHEMA)).count() == 0


def test_blocks_without_hits_are_not_read(spark, monkeypatch):
    """In a clustered table most blocks are left out."""
    rng = np.random.default_rng(2)
    centers = np.sign(rng.standard_normal((40, 8)))
    rows = [(i, [float(x) for x in centers[i % 40] + 0.02 * rng.standard_normal(8)], (i // 40) % 2) for i in range(8000)]
    found = {}
    before = negatives.materialize

    def watched(df, label):
        found.setdefault(label, []).append(out := before(df, label))
        return out

    monkeypatch.setattr(negatives, "materialize", watched)
    monkeypatch.setattr(negatives, "discard", lambda *tables: None)
    monkeypatch.setattr(negatives, "BLOCK", 50)
    got = collected(negatives.mine_negatives(spark.createDataFrame(rows, SCHEMA), every=1000))
    assert got == sorted(brute(rows, 1000))
    pairs = sum(t.count() for t in found["negatives-best"] + found["negatives-chosen"])
    tiles, blocks = found["negatives-anchors"][0].select("tile").distinct().count(), found["negatives-blocks"][0].count()
    assert pairs < 0.6 * tiles * blocks


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (5, 2), (4, 1)])
def test_successive_places_on_the_curve_are_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(2**bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = [k.tobytes() for k in negatives.hilbert_keys(grid, bits)]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    assert len(set(keys)) == len(grid)
    assert set(np.abs(np.diff(grid[order], axis=0)).sum(axis=1)) == {1}


def test_runs_of_one_label():
    labels = ["a"] * 5 + ["b"] * 7 + ["c"] + ["d"] * 3
    batches = [pa.record_batch([pa.array(labels[i : i + 4]), pa.array(range(i, min(i + 4, 16)))], names=["label", "n"]) for i in range(0, 16, 4)]
    runs = [(r.column(0).to_pylist(), r.column(1).to_pylist()) for r in negatives._cut(iter(batches), 3)]
    assert all(len(set(l)) == 1 and len(l) <= 3 for l, _ in runs)
    assert [n for _, r in runs for n in r] == list(range(16))
    assert len(runs) == 2 + 3 + 1 + 1
