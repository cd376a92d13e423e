"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

Features of a text are hashed into `SIZE` slots, in two blocks: words (letters in lower case) and pairs of neighbouring
words; the words' shapes (runs of letters, digits and each other character; a word equal to the one before it has a shape
of its own) and pairs of shapes. A slot's value is log(1 + count), over the Euclidean length of its block, so that words never
seen in training don't drown the shapes, which all languages share.

Training takes `EPOCHS` turns, in a fixed shuffled order, over at most `TRAIN_ROWS` labelled rows, those with the least
xxhash64(doc_id); the bound keeps a training task and the broadcast of the ids of one size however large the corpus is.
`FOLDS` more models, each trained without one part of these rows, score that part; on these scores a slope and an offset
are fitted (Platt's calibration), which the weights then hold. Scoring reads every text.

A null or empty text has no feature, so its score is that of the intercept. Several labels of a document
count as the least of them; repeated rows give repeated results; without any label the score is 0.5; an empty table
gives an empty table; a row of a null doc_id is scored and never learned from; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeworks.llm.common import Ids, blocks, mixed, spread, table, texts

SIZE = 1 << 18
TRAIN_ROWS, FOLDS = 16_000, 3
EPOCHS, ALPHA, BETA, L1, L2 = 6, 0.5, 1.0, 1e-4, 1e-4
MOST_WORDS = 400_000
_RUNS = ((re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"0"))


def shape(word: bytes) -> bytes:
    for run, to in _RUNS:
        word = run.sub(to, word)
    return word


class Features:
    """Slots and values of texts; hashes of words are kept between texts."""

    def __init__(self):
        self._new()

    def _new(self):
        self.ids, self.word, self.shape = Ids(), array("Q"), array("Q")

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = raw.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        if len(self.ids) > MOST_WORDS:
            self._new()
        known = len(self.ids)
        w = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if len(self.ids) > known:
            new = [x for x in dict.fromkeys(words) if self.ids[x] >= known]  # in the order of their numbers
            self.word.extend(zlib.crc32(x.lower()) for x in new)
            self.shape.extend(zlib.crc32(shape(x)) for x in new)
        h, s = np.frombuffer(self.word, np.uint64)[w], np.frombuffer(self.shape, np.uint64)[w]
        s = np.where(np.r_[False, w[1:] == w[:-1]], np.uint64(7), s)
        pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(1 << 40)
        shapes = s[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + s[1:] + np.uint64(2 << 40)
        blocks = []
        for keys in (np.concatenate([h, pair]), np.concatenate([s + np.uint64(3 << 40), shapes])):
            slots, n = np.unique((mixed(keys) & np.uint64(SIZE - 1)).astype(np.int64), return_counts=True)
            x = np.log1p(n).astype(np.float32)
            blocks.append((slots, x / np.sqrt((x * x).sum())))
        return np.concatenate([a for a, _ in blocks]), np.concatenate([x for _, x in blocks])


class FTRL:
    """Follow the regularised leader (proximal), one learning rate for each slot; the last slot is the intercept."""

    def __init__(self):
        self.z, self.n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)

    def weights(self, slots=slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, slots: np.ndarray, x: np.ndarray, y: int) -> None:
        """A slot may come twice (once of each block); each is a step of its own from the same weights."""
        slots, x = np.append(slots, SIZE), np.append(x, 1.0)
        w = self.weights(slots)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[slots]
        np.add.at(self.z, slots, g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w)
        np.add.at(self.n, slots, g * g)


def trained(rows: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights after EPOCHS turns over (y, slots, x) in the order given."""
    model, rows = FTRL(), list(rows)
    for _ in range(EPOCHS):
        for y, slots, x in rows:
            model.learn(slots, x, y)
    return model.weights()


def calibration(sums: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits y to out-of-fold sums best, with Platt's smoothed targets; by
    Newton's method. Labels of one kind, or a slope that isn't positive, leave sums as they are."""
    good, bad = int((y == 1).sum()), int((y == 0).sum())
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, at = np.c_[sums, np.ones(len(sums))], np.array([1.0, 0.0])
    hold = np.diag([1e-3, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ at, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + hold + 1e-6 * np.eye(2), a.T @ (p - target) + hold @ (at - (1, 0)))
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def fit(labelled: DataFrame) -> np.ndarray:
    """Calibrated weights from labelled (doc_id, text, y): SIZE slots and the intercept. The models are trained side by side,
    a task for each."""

    def extract(batches):
        import pyarrow as pa

        features = Features()
        for batch in blocks(batches):
            got = [features(t) for t in batch.column("text").cast("binary").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([a.astype("<i4").tobytes() for a, _ in got]), pa.array([b.tobytes() for _, b in got])], names=["doc_id", "y", "slots", "x"])

    def train(key, group):
        import pyarrow as pa

        left_out = key[0].as_py()  # FOLDS: none
        rows = list(zip(*(group.column(c).to_pylist() for c in ("doc_id", "y", "slots", "x"))))
        rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[2]))
        fold = mixed(np.array([r[0] for r in rows], np.int64).view(np.uint64)) % np.uint64(FOLDS)
        vectors = [(y, np.frombuffer(slots, "<i4"), np.frombuffer(x, np.float32)) for _, y, slots, x in rows]
        w = trained(v for v, f in zip(vectors, fold) if f != left_out)
        if left_out == FOLDS:
            at = np.flatnonzero(w)
            return pa.table({"y": pa.nulls(len(at), pa.int32()), "slot": pa.array(at.astype(np.int32)), "w": pa.array(w[at])})
        out = [(y, float(w[slots] @ x + w[SIZE])) for (y, slots, x), f in zip(vectors, fold) if f == left_out]
        return pa.table({"y": pa.array([y for y, _ in out], pa.int32()), "slot": pa.nulls(len(out), pa.int32()), "w": pa.array([z for _, z in out], pa.float64())})

    found = spread(labelled.select("doc_id", "text", "y"), "doc_id").mapInArrow(extract, "doc_id long, y int, slots binary, x binary")
    models = F.explode(F.array(*map(F.lit, range(FOLDS + 1)))).alias("model")
    got = found.select("*", models).groupBy("model").applyInArrow(train, "y int, slot int, w double").toArrow()  # SIZE + 1 + TRAIN_ROWS rows at most
    y, slot, w = (got.column(c).to_numpy() for c in ("y", "slot", "w"))
    scored = ~np.isnan(y.astype(float))
    weights = np.zeros(SIZE + 1)
    weights[slot[~scored].astype(int)] = w[~scored]
    slope, offset = calibration(w[scored], y[scored])
    weights *= slope
    weights[SIZE] += offset
    return weights


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """docs with a column text, scored: all columns of docs but text, then score and predicted."""
    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes if c != "text"] + ["score double", "predicted int"])
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def rate(batches):
        import pyarrow as pa

        features, w = Features(), sent.value
        for batch in blocks(batches):
            sums = []
            for t in batch.column("text").cast("binary").to_pylist():
                slots, x = features(t)
                sums.append(float(w[slots] @ x) + float(w[SIZE]))
            p = 1 / (1 + np.exp(-np.clip(np.array(sums), -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.withColumn("text", F.coalesce("text", F.lit(""))).mapInArrow(rate, schema)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text, y) of the labelled documents to learn from."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return texts(docs).join(F.broadcast(chosen), "doc_id")  # at most `rows` ids


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(spread(texts(docs, held.alias("held_out")), "doc_id"), weights)
