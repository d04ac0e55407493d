"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates.

Words of the whole text are seen in two ways, both hashed into n-grams: their letters in lower case
(1- and 2-grams), and their shape (1- to 3-grams), which keeps letter case, length class and the
signs around the letters, so that layout shows even in words that were never seen. A feature's value
is its share of the text's n-grams, so long and short texts compare.

Edge cases: null, empty and word-less texts have nothing to keep and get the score 0, a rule beside the
model; without labelled rows of both classes all other scores are 0.5; repeated ids are scored row by
row; other columns pass unused.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ftrl
from .tokens import CodeCache, chunks, crc, gap_pairs, pair, spread, word_codes

BITS = 20
SAMPLE_ROWS = 6000
SETTINGS = {
    "epochs": 3,
    "min_seen": 2,
    "positive_importance": 1.0,
    "alpha": 2.0,
    "beta": 1.0,
    "l1": 0.002,
    "l2": 0.001,
}
SCALE = 30.0


def _code(word: bytes) -> int:
    """The hash of the letters in the upper half, that of the shape in the lower half."""
    text = word.decode("utf-8", "replace")
    start, end = 0, len(text)
    while start < end and not text[start].isalnum():
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    core = text[start:end]
    if not core:
        shape = text[:6]
    else:
        case = "D" if core[0].isdigit() else "U" if core.isupper() and len(core) > 1 else "T" if core[0].isupper() else "L"
        shape = f"{text[:start][:3]}{case}{min(len(core), 12) // 4}{text[end:][:3]}"
    return crc(core.lower().encode("utf-8", "replace")) << 32 | crc(shape.encode("utf-8", "replace"))


_cache = CodeCache(_code)


def occurrences(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Feature index and text number of every n-gram, repeats included."""
    codes, row = word_codes(texts, _cache)
    w, s = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
    parts = [(spread(w, 1, BITS), row), (spread(s, 2, BITS), row)]
    for h, salt in ((w, 3), (s, 4)):
        pairs, at = gap_pairs(h, row, 1)
        parts.append((spread(pairs, salt, BITS), at))
    if len(s) > 2:
        same = row[2:] == row[:-2]
        parts.append((spread(pair(pair(s[:-2], s[1:-1]), s[2:])[same], 5, BITS), row[2:][same]))
    return np.concatenate([p for p, _ in parts]), np.concatenate([r for _, r in parts])


def features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    index, row = occurrences(texts)
    distinct, count = np.unique(row << BITS | index, return_counts=True)
    at = distinct >> BITS
    total = np.bincount(row, minlength=len(texts))
    return (distinct & ((1 << BITS) - 1)).astype(np.int32), SCALE * count / total[at], at


def fit(
    docs: DataFrame,
    labels: DataFrame,
    eligible: Column,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> np.ndarray:
    """Weights learned from at most ``sample_rows`` labelled rows whose ``id`` is ``eligible``."""
    rows = ftrl.training_rows(docs, labels, label, id_col, text_col, eligible, sample_rows)
    return ftrl.train(rows, features, BITS, **SETTINGS)


def score_texts(texts: list, weights: np.ndarray) -> np.ndarray:
    """The probability of label 1: the mean weight of a text's n-grams is its sparse dot product."""
    out = []
    for part in chunks(texts):
        index, row = occurrences(part)
        total = np.bincount(row, minlength=len(part))
        chance = ftrl.sigmoid(SCALE * np.bincount(row, weights[index], len(part)) / np.maximum(total, 1))
        out.append(np.where(total > 0, chance, 0.0))
    return np.concatenate(out) if out else np.empty(0)


def score(spark, text: Column, weights: np.ndarray) -> Column:
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts, shared.value))

    return run(text.cast("string"))
