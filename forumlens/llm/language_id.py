"""Language identification by language-bitmask n-gram filters.

A Bloom filter over letter n-grams whose slots hold a bit for each language (bit slices side by
side): adding an n-gram sets its language's bit in ``HASHES`` slots, and the AND of an n-gram's slots
tells at once all languages that contain it. A language contains the n-grams that occur in at least
``min_share`` of its training texts. For a text, each language's matching n-grams are counted; a
count c of n n-grams is corrected for the language's false-positive rate f, which follows from how
full its slice is: (c - n f) / (1 - f). The largest corrected count decides, ties by name.

Texts are lower-cased; runs of anything but letters count as one space.

Edge cases: null texts and texts without a letter give ``und`` and score 0; so does everything when
there's no training text. A text with letters of which no n-gram is known gets the first language by
name and score 0. Repeated ids give a row each; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import chunks

SIZES = (2, 3, 4)
SLOT_BITS = 18
HASHES = 2
SAMPLE_PER_LANGUAGE = 1500
MIN_SHARE = 0.03
UNDETERMINED = "und"
#: languages in one mask
GROUP = 62

_table: list = []


def _letters() -> np.ndarray:
    """Code point -> lower-cased letter, or 32 for anything else (beyond the BMP: see fold)."""
    if not _table:
        table = np.full(1 << 16, 32, np.uint32)
        for c in range(1 << 16):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low[0])
        _table.append(table)
    return _table[0]


def fold(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters of the texts, a space after each text, and the number of the text of each."""
    joined = " ".join(t or "" for t in texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t or "") + 1 for t in texts])
    far = points >= 1 << 16
    out = _letters()[np.where(far, 32, points)]
    if far.any():
        out[far] = [p if chr(p).isalpha() else 32 for p in points[far].tolist()]
    space = out == 32
    # a run of other characters counts as one space
    inner = space.copy()
    inner[1:] &= space[:-1] & (row[1:] == row[:-1])
    inner[0] = False
    return out[~inner], row[~inner]


def grams(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, text number) of the n-grams of each size; none spans two texts."""
    points, row = fold(texts)
    out = []
    h = points.astype(np.uint64)
    for n in range(2, max(SIZES) + 1):
        h = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ points[n - 1 :]
        if n in SIZES:
            own = row[: len(h)] == row[n - 1 :]
            mixed = (h[own] + np.uint64(n)) * np.uint64(0xFF51AFD7ED558CCD)
            out.append((mixed ^ (mixed >> np.uint64(31)), row[: len(h)][own]))
    return out


def slots(h: np.ndarray) -> list[np.ndarray]:
    a = (h * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(64 - SLOT_BITS)
    b = (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SLOT_BITS)
    return [a.astype(np.int32), b.astype(np.int32)][:HASHES]


@dataclass
class Filters:
    languages: list[str]
    tables: list[np.ndarray]  # for each group of languages: a mask per slot

    def false_positive_rates(self) -> np.ndarray:
        rates = []
        for i in range(len(self.languages)):
            bits = self.tables[i // GROUP] >> np.int64(i % GROUP) & 1
            rates.append(float(bits.mean()) ** HASHES)
        return np.array(rates)

    def counts(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Matching n-grams by text and language, and all n-grams by text."""
        hits, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for h, row in grams(texts):
            total += np.bincount(row, minlength=len(texts))
            where = slots(h)
            for g, table in enumerate(self.tables):
                mask = table[where[0]]
                for w in where[1:]:
                    mask &= table[w]
                for i in range(g * GROUP, min(len(self.languages), (g + 1) * GROUP)):
                    hits[:, i] += np.bincount(row, mask >> np.int64(i - g * GROUP) & 1, len(texts))
        return hits, total

    def predict(self, texts: list) -> list[tuple[str, float]]:
        out, rate = [], self.false_positive_rates()
        for part in chunks(texts):
            if self.languages:
                hits, total = self.counts(part)
                fixed = np.maximum((hits - total[:, None] * rate) / np.maximum(1 - rate, 1e-9), 0)
                best, every = fixed.argmax(axis=1), fixed.sum(axis=1)
            for i, t in enumerate(part):
                if not self.languages or not any(map(str.isalpha, t or "")):
                    out.append((UNDETERMINED, 0.0))
                else:
                    share = fixed[i, best[i]] / every[i] if every[i] else 0.0
                    out.append((self.languages[best[i]], float(share)))
        return out


def fit(
    docs: DataFrame,
    eligible: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
    min_share: float = MIN_SHARE,
) -> Filters:
    """Filters learned from at most ``sample_per_language`` eligible rows of each language.

    ``eligible`` is a condition on ``id``. The sample is the first rows by a hash of the id. Slots
    and masks are gathered on the executors; the driver gets one row for each slot at most.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where("id is not null and lang is not null and text is not null")
    rows = rows.where(eligible)
    # rows far behind in a language's order go before the ranking, so a frequent language isn't gathered
    span = 1 << 40
    keyed = rows.select("id", "lang", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(span)).alias("hash")).distinct()  # an id counts once
    sizes = keyed.groupBy("lang").agg(F.count("*").alias("all"))
    # a row for each language, as many as the filters themselves hold
    ahead = keyed.join(F.broadcast(sizes), "lang").where(F.col("hash") * F.col("all").cast("double") <= span * (1.5 * sample_per_language + 100))
    by_hash = Window.partitionBy("lang").orderBy("hash", "id")
    chosen = ahead.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= sample_per_language)
    ids = [r.id for r in chosen.select("id").distinct().collect()]  # bounded by the sample
    languages = sorted(r.lang for r in chosen.select("lang").distinct().collect())
    if not ids:
        return Filters([], [])
    picked = docs.sparkSession.createDataFrame([(i,) for i in ids], "id long")
    # of several rows of an id the smallest text of each of its languages is taken
    sample = rows.join(F.broadcast(picked), "id").groupBy("id", "lang").agg(F.min(F.struct("text")).alias("t")).select("lang", "t.text")

    def run(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs) if x == lang]
                parts = [np.zeros(0, np.uint64)]
                for part in chunks(own):
                    for h, row in grams(part):
                        order = np.lexsort((h, row))
                        h, row = h[order], row[order]
                        first = np.ones(len(h), bool)
                        first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                        parts.append(h[first])
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                total = pa.array([len(own), *n.tolist()], pa.int64())
                keys = pa.array([None, *h.view(np.int64).tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total)), keys, total], ["lang", "gram", "n"])

    counted = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("all", F.max(F.when(F.col("gram").isNull(), F.col("n"))).over(Window.partitionBy("lang")))
    known = counted.where(F.col("gram").isNotNull() & (F.col("n") >= F.greatest(F.lit(2.0), F.col("all") * min_share)))
    place = {x: i for i, x in enumerate(languages)}

    def fill(batches):
        for batch in batches:
            langs = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            h = np.array(batch.column(1).to_pylist(), np.int64).view(np.uint64)
            slot = np.concatenate(slots(h)) if len(h) else np.zeros(0, np.int32)
            both = np.tile(langs, HASHES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot, pa.int32()), pa.array(both // GROUP, pa.int64()), pa.array(np.int64(1) << (both % GROUP), pa.int64())],
                ["slot", "part", "mask"],
            )

    masks = known.select("lang", "gram").mapInArrow(fill, "slot int, part long, mask long")
    tables = [np.zeros(1 << SLOT_BITS, np.int64) for _ in range(-(-len(languages) // GROUP))]
    for r in masks.groupBy("slot", "part").agg(F.bit_or("mask").alias("mask")).collect():
        tables[r.part][r.slot] = r.mask
    return Filters(languages, tables)


def predict(spark, text: Column, filters: Filters) -> Column:
    """A struct (lang_pred, score) for each whole text."""
    shared = spark.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.predict(list(texts)), columns=["lang_pred", "score"])

    return run(text.cast("string"))
