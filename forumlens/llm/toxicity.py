"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate rates let rare insulting words learn fast while common words stay still, and the L1
term keeps nearly all weights at exactly zero, so the broadcast form is a bitmap of the features that
have a weight, and a short sorted list of those. A feature (a lower-cased word without the signs
around it, a pair of neighbours, or a pair with one word between) counts once per text, however
often it occurs.

Edge cases: null and empty texts have the bias alone; without labelled rows of both classes all
scores are 0.5; repeated ids are scored row by row; other columns pass unused.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ftrl
from .tokens import CodeCache, chunks, crc, gap_pairs, spread, word_codes

BITS = 22
SAMPLE_ROWS = 10_000
SETTINGS = {
    "epochs": 4,
    "min_seen": 3,
    "positive_importance": 6.0,  # toxic rows are rare among the labelled ones
    "alpha": 2.0,
    "beta": 1.0,
    "l1": 20.0,
    "l2": 0.01,
}
BIAS = 0


def _code(word: bytes) -> int:
    text = word.decode("utf-8", "replace").lower()
    start, end = 0, len(text)
    while start < end and not text[start].isalnum():
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return crc(text[start:end].encode("utf-8", "replace"))


_cache = CodeCache(_code)


def occurrences(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature index, text number) of words, neighbours and skip-grams, repeats included."""
    codes, row = word_codes(texts, _cache)
    parts = [(spread(codes, 1, BITS), row)]
    for gap in (1, 2):
        pairs, at = gap_pairs(codes, row, gap)
        parts.append((spread(pairs, 1 + gap, BITS), at))
    return parts


def features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [r << BITS | i for i, r in occurrences(texts)]
    keys = np.unique(np.concatenate([*parts, np.arange(len(texts)) << BITS | BIAS]))
    return (keys & ((1 << BITS) - 1)).astype(np.int32), np.ones(len(keys)), keys >> BITS


class Weights:
    """Sparse weights: a bitmap to look up quickly, and the sorted indices with their values."""

    def __init__(self, dense: np.ndarray):
        self.index = np.flatnonzero(dense).astype(np.int32)
        self.value = dense[self.index].astype(np.float64)
        self.bias = float(dense[BIAS])
        self.bitmap = np.packbits(dense != 0, bitorder="little")

    def score(self, texts: list) -> np.ndarray:
        out = []
        for part in chunks(texts):
            hits = []
            for index, row in occurrences(part):
                has = (self.bitmap[index >> 3] >> (index & 7).astype(np.uint8)) & 1
                has = has.astype(bool)
                hits.append(row[has] << BITS | index[has])
            keys = np.unique(np.concatenate(hits))
            at = keys & ((1 << BITS) - 1)
            keys, at = keys[at != BIAS], at[at != BIAS]
            value = self.value[np.searchsorted(self.index, at)] if len(self.index) else np.zeros(len(at))
            out.append(ftrl.sigmoid(self.bias + np.bincount(keys >> BITS, value, len(part))))
        return np.concatenate(out) if out else np.empty(0)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    eligible: Column,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> Weights:
    """Weights learned from at most ``sample_rows`` labelled rows whose ``id`` is ``eligible``."""
    rows = ftrl.training_rows(docs, labels, label, id_col, text_col, eligible, sample_rows)
    return Weights(ftrl.train(rows, features, BITS, **SETTINGS))


def score(spark, text: Column, weights: Weights) -> Column:
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts))

    return run(text.cast("string"))
