"""Quality scores by co-training a text view and a metadata view."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import materialize
from .trigrams import trigram_counts

#: The models are fitted on at most so many labelled documents, those of the least id hashes.
MOST_LABELLED = 8_000
#: Rounds in which the views exchange labels. In each, every document without a label is scored by both views; of all those
#: of which a view is sure, so many of each class, of the least hashes, train the other view.
ROUNDS, HANDED = 4, 400
#: A label is handed over if its view is at least that sure.
SURE = 0.95
#: Weight of a handed-over label beside a given one.
HANDED_WEIGHT = 0.5
#: Every third labelled document is held out for calibration.
HELD_OUT = 3

BITS = 8
SOURCES, LANGUAGES = 64, 16


def text_features(text: str | None) -> np.ndarray:
    """What the text itself shows: hashed trigram frequencies and the makeup of its words and lines."""
    counts = trigram_counts(text, BITS).astype(np.float64)
    words = (text or "").split()
    lines = [x for x in (text or "").split("\n") if x.strip()]
    chars = sum(map(len, words)) or 1
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    kinds = [np.count_nonzero((raw >= a) & (raw <= b)) / max(len(raw), 1) for a, b in ((48, 57), (33, 47), (58, 64), (91, 96), (123, 126), (65, 90), (128, 255))]
    makeup = [np.log1p(len(words)), chars / (len(words) or 1) / 8, len(set(words)) / (len(words) or 1), 1 - len(set(lines)) / (len(lines) or 1)]
    return np.concatenate([np.sqrt(counts / (counts.sum() or 1)), np.sqrt(kinds), makeup])


def page_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """What is known without the text: language, source and length."""
    out = np.zeros(LANGUAGES + SOURCES + 3)
    out[zlib.crc32((lang or "").encode()) % LANGUAGES] = 1
    out[LANGUAGES + zlib.crc32((source or "").encode()) % SOURCES] = 1
    size = np.log1p(max(n_chars or 0, 0)) / 8
    out[-3:] = size, size * size, size < 0.6
    return out


@dataclass(frozen=True)
class Logistic:
    """Ridge logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        beta, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            gradient = z.T @ (w * (p - y)) + penalty * beta
            hessian = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
            step = np.linalg.solve(hessian, gradient)
            beta = beta - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, beta)

    def score(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass(frozen=True)
class Views:
    """Both views' models, their calibrations, and the model that combines them."""

    models: tuple[Logistic, Logistic]
    platts: tuple[Logistic, Logistic]
    both: Logistic

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality by text, by metadata, and by both."""
        logits = [c.score(m.score(x)[:, None]) for m, c, x in zip(self.models, self.platts, (text, page), strict=True)]
        return sigmoid(logits[0]), sigmoid(logits[1]), sigmoid(self.both.score(np.column_stack(logits)))


Sure = Callable[[tuple[Logistic, Logistic], tuple[Logistic, Logistic]], list[tuple[int, int, float, np.ndarray, np.ndarray]]]


def sure_of_arrays(text: np.ndarray, page: np.ndarray, keys: np.ndarray | None = None) -> Sure:
    """The same draw as :func:`_sure_rows` from documents in memory; keys are their numbers unless given."""
    keys = np.arange(len(text)) if keys is None else keys

    def draw(models, platts):
        out = []
        for v, x in enumerate((text, page)):
            p = sigmoid(platts[v].score(models[v].score(x)[:, None]))
            for label, certain in ((0, 1 - p >= SURE), (1, p >= SURE)):
                at = np.flatnonzero(certain)
                for i in at[np.argsort(keys[at], kind="stable")][:HANDED]:
                    out.append((v, int(keys[i]), float(label), text[i], page[i]))
        return out

    return draw


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, sure: Sure | tuple[np.ndarray, np.ndarray]) -> Views | None:
    """Fit both views; None if a class is missing where it is needed.

    ``sure(models, platts)`` gives, for the views' present state, the documents
    that each view is sure of: (view, key, label, text features, page features).
    Two arrays of features are a pool in memory to draw them from.
    """
    sure = sure if callable(sure) else sure_of_arrays(*sure)
    held = np.arange(len(y)) % HELD_OUT == HELD_OUT - 1
    if min(len(np.unique(y[held])), len(np.unique(y[~held]))) < 2:
        return None
    given = y[~held].astype(float)
    # By view, what the other one handed to it: label and features of each document.
    handed: list[dict[int, tuple[float, np.ndarray]]] = [{}, {}]
    for round_ in range(ROUNDS + 1):
        models, platts = [], []
        for v in (0, 1):
            more = [handed[v][k] for k in sorted(handed[v])]
            x = np.concatenate([views[v][~held], *[f[None, :] for _, f in more]])
            labels = np.concatenate([given, [label for label, _ in more]])
            weights = np.concatenate([np.ones(len(given)), np.full(len(more), HANDED_WEIGHT)])
            models.append(Logistic.fit(x, labels, weights))
            platts.append(Logistic.fit(models[v].score(views[v][held])[:, None], y[held].astype(float), np.ones(held.sum()), 1e-2))
        if round_ == ROUNDS:
            break
        for v, key, label, text, page in sure((models[0], models[1]), (platts[0], platts[1])):
            handed[1 - v].setdefault(key, (label, (page, text)[v]))
    logits = np.column_stack([c.score(m.score(x[held])[:, None]) for m, c, x in zip(models, platts, views, strict=True)])
    return Views(tuple(models), tuple(platts), Logistic.fit(logits, y[held].astype(float), np.ones(held.sum()), 1e-2))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 200):
            part = batch.slice(start, 200)
            text = [text_features(t.as_py()).astype("<f4").tobytes() for t in part.column("text")]
            page = [page_features(*x).astype("<f4").tobytes() for x in zip(*[part.column(c).to_pylist() for c in ("lang", "source", "n_chars")], strict=True)]
            yield pa.record_batch([part.column("id"), pa.array(text, pa.binary()), pa.array(page, pa.binary())], names=["id", "t", "p"])


def _matrix(column: pa.Array) -> np.ndarray:
    found = column.to_pylist()
    return np.stack([np.frombuffer(b, "<f4") for b in found]).astype(np.float64) if found else np.empty((0, 1))


def _sure_rows(pool: DataFrame) -> Sure:
    """Scores all of ``pool`` (``key, t, p``) and draws from every row of which a view is sure."""

    def draw(models, platts):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # A task needs to send no more than all tasks together may hand over.
            best: dict[tuple[int, int], list[int]] = {}
            for batch in batches:
                for start in range(0, len(batch), 1000):
                    part = batch.slice(start, 1000)
                    key = part.column("key").to_numpy()
                    for v, name in enumerate(("t", "p")):
                        p = sigmoid(platts[v].score(models[v].score(_matrix(part.column(name)))[:, None]))
                        for label, certain in ((1, p >= SURE), (0, 1 - p >= SURE)):
                            if certain.any():
                                best[v, label] = sorted({*best.get((v, label), []), *key[certain].tolist()})[:HANDED]
            rows = [(v, label, k) for (v, label), keys in best.items() for k in keys]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["view", "label", "key"])

        rank = F.row_number().over(Window.partitionBy("view", "label").orderBy("key"))
        chosen = pool.mapInArrow(run, "view int, label int, key long").distinct().withColumn("rank", rank).where(F.col("rank") <= HANDED).drop("rank")
        # At most 4 * HANDED rows: small enough to broadcast, whatever the corpus.
        found = pool.join(F.broadcast(materialize(chosen, "quality-sure")), "key").dropDuplicates(["view", "label", "key"]).orderBy("view", "label", "key").toArrow()
        rows = zip(*[found.column(c).to_pylist() for c in ("view", "key", "label")], _matrix(found.column("t")), _matrix(found.column("p")), strict=True)
        return [(v, k, float(label), t, p) for v, k, label, t, p in rows]

    return draw


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """For every row of ``docs``: ``<id_col>, p_text, p_page, score``.

    ``docs`` has the columns ``text, lang, source, n_chars``, ``labels`` an id
    and a 0/1 label. Two logistic models see the text and the metadata. In each
    round each view labels the unlabelled documents of which it is sure and hands
    them to the other view. Both are calibrated on held-out labels and combined.

    The fit uses a bounded sample of the labels (``MOST_LABELLED``). The labels that
    the views exchange come from all documents without one: each round scores every
    one of them, and a bounded number of those sure enough trains the other view.
    Every row is scored. Null text, language and source count as empty, null
    lengths as 0. Rows that repeat an id are scored one by one; one of them, the
    least, trains. Ids that are labelled twice with different values, null labels
    and null ids do not train; ties of hashes go to the smaller one. If a class is
    missing every probability is 0.5. Texts are read whole. An empty table gives an
    empty result; columns other than the named ones are not looked at.
    """
    rows = docs.select(F.col(id_col).alias("id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    kind = rows.schema["id"].dataType.simpleString()
    features = materialize(rows.mapInArrow(_feature_rows, f"id {kind}, t binary, p binary"), "quality-features")
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("most"))
    marks = materialize(marks.where("label = most and id is not null").select("id", F.col("label").cast("int").alias("label")), "quality-labels")
    # One row for each labelled id, the least; ids of the least hashes.
    known = features.join(marks, "id").groupBy("id", "label").agg(F.min(F.struct("t", "p")).alias("f")).select("id", "label", "f.*")
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(MOST_LABELLED).orderBy(F.xxhash64("id"), "id").toArrow()
    pool = features.where("id is not null").join(marks.select("id"), "id", "left_anti").select(F.xxhash64("id", "t", "p").alias("key"), "t", "p")
    y = drawn.column("label").to_numpy()
    fitted = co_train((_matrix(drawn.column("t")), _matrix(drawn.column("p"))), y, _sure_rows(pool)) if len(y) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.slice(start, 1000)
                found = [np.full(len(part), 0.5)] * 3 if fitted is None else fitted.scores(_matrix(part.column("t")), _matrix(part.column("p")))
                yield pa.record_batch([part.column("id"), *[pa.array(f, pa.float64()) for f in found]], names=[id_col, "p_text", "p_page", "score"])

    return features.mapInArrow(run, f"`{id_col}` {kind}, p_text double, p_page double, score double")
