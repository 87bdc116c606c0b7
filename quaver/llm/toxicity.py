"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word pairs and pairs with one word between,
hashed into ``BUCKETS`` coordinates. Training is one sequential pass repeated ``EPOCHS``
times over labelled texts in the order of their ids' hashes, at most ``MAX_TRAIN`` of
them and at most ``MAX_FEATURES`` features in all, in one task that these two bounds fix
(four bytes a feature); every coordinate has its own rate, and L1 keeps most weights at
exactly 0. The weights that are left, ``BUCKETS`` at most, are broadcast, and
all texts are scored where they are, without a shuffle.

Only the text decides a score. Edge cases: null and empty texts get the score of no
features. Labels that are null, or whose document is missing, teach nothing; a document
with several labels is learnt once for each; ids whose hashes tie come in the order of
label and features. Without any label every score is 0.5. A very long text is scored
whole. Repeated rows each get the same score. Rows without an id are scored and not held
out. Ids may be of any type. An empty table gives an empty one. Extra columns are not
read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import mix64, slices, words_of
from .workspace import materialize

BITS = 18
BUCKETS = 1 << BITS
MAX_TRAIN = 16_384
MAX_FEATURES = 1 << 25
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.6, 1.0, 10.0, 1.0
BREAKS = b".,;:!?\"'()[]|"
BIAS = 0


def features(words: np.ndarray) -> np.ndarray:
    """Distinct coordinates of a text's words, pairs and skip pairs, and the bias."""
    parts = [words]
    with np.errstate(over="ignore"):
        if len(words) > 1:
            parts.append(mix64(words[:-1] * np.uint64(3) + words[1:]))
        if len(words) > 2:
            parts.append(mix64(words[:-2] * np.uint64(5) + words[2:] + np.uint64(1)))
    at = np.unique(np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate([[BIAS], at[at != BIAS]])


class Ftrl:
    """FTRL-proximal with per-coordinate rates."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(BUCKETS), np.zeros(BUCKETS)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            w = words_of(batch.column(2), breaks=BREAKS)
            found = [features(w.hashes[w.doc_start[i] : w.doc_start[i + 1]]).astype("<i4").tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["turn", "y", "at"])


def _train(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for batch in batches:
        for y, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            size += len(raw) // 4
            if size <= most:
                rows.append((np.frombuffer(raw, "<i4"), y))
        if size > most:
            break
    model = Ftrl()
    for _ in range(EPOCHS if rows else 0):
        for at, y in rows:
            model.learn(at, y)
    w = model.weights(np.arange(BUCKETS))
    some = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(w[some])], names=["at", "w"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES) -> np.ndarray:
    """The weights of a model of ``labels`` (doc_id, label 0 or 1) on the texts of ``docs``."""
    turn = F.xxhash64(F.lit(5), F.col(doc_id))
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    chosen = known.select(F.col(doc_id).alias("__id"), F.col(label).cast("double").alias("y"), turn.alias("turn")).orderBy("turn", "y").limit(max_train)
    texts = docs.select(F.col(doc_id).alias("__doc"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("turn", "y", "text")  # max_train rows are broadcast
    rows = materialize(rows.mapInArrow(_featurise, "turn long, y double, at binary"), "features")
    weights = np.zeros(BUCKETS)
    learnt = rows.repartition(1).sortWithinPartitions("turn", "y", "at").mapInArrow(lambda b: _train(b, max_features), "at long, w double")
    for at, w in learnt.collect():  # BUCKETS rows at most
        weights[at] = w
    return weights


def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            w = words_of(batch.column(2), breaks=BREAKS)
            total = np.array([weights[features(w.hashes[w.doc_start[i] : w.doc_start[i + 1]])].sum() for i in range(batch.num_rows)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["id", "held_out", "score"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, score) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    rows = docs.select(F.col(doc_id).alias("id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda b: _score(b, sent.value.astype(np.float64)), f"id {rows.schema['id'].dataType.simpleString()}, held_out boolean, score double")
