"""Logistic regression over hashed sparse features, trained by FTRL-proximal updates.

Training streams a bounded, deterministic sample of labelled rows through one task; only the weight
vector comes back, and its size is fixed by ``bits``. Scoring is a Column, so it runs where the rows
are and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: texts -> (feature indices, feature values, number of the text); a text's indices are distinct.
Featurizer = Callable[[list], tuple[np.ndarray, np.ndarray, np.ndarray]]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class FTRL:
    """Per-coordinate FTRL-proximal state; weights follow from it in closed form."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def _solve(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int, importance: float = 1.0) -> None:
        """One update, its gradient multiplied by ``importance``; index must be distinct."""
        z, n = self.z[index], self.n[index]
        w = self._solve(z, n)
        gradient = importance * (sigmoid(float(w @ value)) - label) * value
        squared = gradient * gradient
        sigma = (np.sqrt(n + squared) - np.sqrt(n)) / self.alpha
        self.z[index] = z + gradient - sigma * w
        self.n[index] = n + squared

    def weights(self) -> np.ndarray:
        return self._solve(self.z, self.n).astype(np.float32)


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, eligible: Column, bound: int
) -> DataFrame:
    """At most ``bound`` labelled rows (id, text, label, rank), the first by a hash of the id.

    ``eligible`` is a condition on the id, named ``id``. Repeated label rows of an id count once
    (the larger label), and so do repeated text rows (null or the smallest text), put together before
    they are shuffled; ids with null labels or without a text row give none.
    """
    marked = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
        .where("id is not null and label in (0, 1)")
        .where(eligible)
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    chosen = marked.withColumn("rank", F.xxhash64("id", F.lit(2))).orderBy("rank", "id").limit(bound)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # at most ``bound`` small rows are broadcast
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label", "rank").agg(F.min(F.struct("text")).alias("t"))
    return found.select("id", "t.text", "label", "rank")


def learn_weights(
    examples: list, bits: int, epochs: int, min_seen: int, positive_importance: float, **rates
) -> np.ndarray:
    """Weights from (index, value, label) examples, in their order, ``epochs`` times over.

    Features of fewer than ``min_seen`` examples are left out, which keeps the state small; without
    both labels all weights are zero.
    """
    out = np.zeros(1 << bits, np.float32)
    if len({label for *_, label in examples}) < 2:
        return out
    seen = np.zeros(1 << bits, np.int32)
    for index, _, _ in examples:
        seen[index] += 1
    kept = np.flatnonzero(seen >= min_seen)
    place = np.full(1 << bits, -1, np.int32)
    place[kept] = np.arange(len(kept))
    dense = []
    for index, value, label in examples:
        at = place[index]
        dense.append((at[at >= 0], value[at >= 0].astype(np.float64), label))
    model = FTRL(len(kept), **rates)
    for _ in range(epochs):
        for index, value, label in dense:
            model.learn(index, value, label, positive_importance if label else 1.0)
    out[kept] = model.weights()
    return out


def train(rows: DataFrame, featurize: Featurizer, bits: int, **settings) -> np.ndarray:
    """Weights for (id, text, label, rank) rows, learned in the order of rank by one task."""

    def run(batches):
        examples = []
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                index, value, _ = featurize([text])
                examples.append((index.astype(np.int32), value.astype(np.float32), label))
        weights = learn_weights(examples, bits, **settings)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    one = rows.repartition(1).sortWithinPartitions("rank", "id").select("text", "label")
    row = one.mapInArrow(run, "weights binary").first()
    # an empty table may be planned away, and then no task has run
    return np.frombuffer(row[0], np.float32) if row else np.zeros(1 << bits, np.float32)
