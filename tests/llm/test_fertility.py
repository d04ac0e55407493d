import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import sentencepiece
from forumlens.llm import fertility, queries
from pyspark.sql import functions as F

SP = sentencepiece.SentencePieceProcessor(model_file=fertility.MODEL)
NAMES = [c.strip().split(" ")[0] for c in fertility.SCHEMA.split(",")]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    ids = [i for x in w for i in SP.encode(x)]
    c = Counter(ids)
    h = -sum(v / len(ids) * math.log2(v / len(ids)) for v in c.values()) if ids else None
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup,
        "n_repeat_words": len(marked),
        "n_tokens": len(ids),
        "byte_share": sum(map(SP.is_byte, ids)) / len(ids) if ids else None,
        "entropy": h,
        "chars_per_token": sum(map(len, w)) / len(ids) if ids else None,
    }


def texts():
    rng = random.Random(5)
    pool = ["the", "Große", "ciónes", "☃", "𝔘", "a b", "#1", "<b>", "x|y", "Привет", "中文"]
    yield from (None, "", " \n\t", "a a a a a", "x\nx\n\nx\n \n", "one two three one two three")
    for _ in range(80):
        yield "".join(rng.choice(pool) + rng.choice([" ", "\n", "  ", "\r\n", "\x0b"]) for _ in range(rng.choice([3, 60, 400])))
    yield "word " * 30000


def test_measures_match_brute_force():
    every = list(texts())
    for text, row in zip(every, fertility.measure(every)):
        got = dict(zip(NAMES, row))
        for name, value in brute(text).items():
            assert got[name] == value or math.isclose(got[name], value, rel_tol=1e-9, abs_tol=1e-9), name


def test_query(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = fertility.quality_rules(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert fertility.quality_rules(docs.limit(0)).count() == 0


def test_bands_reject_bytes(spark):
    runes = " ".join(chr(0x16A0 + i % 70) * 3 for i in range(80))
    mixed = " ".join("abc" + chr(0x16A0 + i % 70) * 3 for i in range(80))
    plain = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, runes), (2, mixed), (3, plain)], "doc_id long, text string")
    kept = {r.id: r.kept for r in fertility.quality_rules(docs).collect()}
    assert kept == {1: False, 2: False, 3: True}


def test_fitted_bands_reject_junk(spark):
    """Held-out labelled rows that pass the base rules: the bands themselves tell good texts from bad ones."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.where(queries.crc_mod(F.col("doc_id"), 5) == 0)
    got = queries.QUERIES["op3_quality_rules"](spark, sf).where("not base_failed").join(held, "doc_id")
    rate = {r.quality: (r.n, r.kept) for r in got.groupBy("quality").agg(F.count("*").alias("n"), F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[0][0] > 30 and rate[0][1] < 0.1
    assert rate[1][0] > 300 and rate[1][1] > 0.95


def test_bands_without_a_sample(spark):
    docs = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(80)), None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    bands = fertility.fit_bands(docs, labels, F.lit(True))
    assert bands == {}
    assert [r.kept for r in fertility.quality_rules(docs, bands=bands).collect()] == [True]


def test_an_id_of_many_rows_is_measured_once(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(90)), "en") for i in range(150)]
    odd = (5, "odd ### $$$ " + " ".join(rng.choice(words) for _ in range(70)), "en")
    kind = "doc_id long, text string, lang string"
    labels = spark.createDataFrame([(i, 1) for i in range(150)], "doc_id long, quality int")
    once = fertility.fit_bands(spark.createDataFrame([*rows, odd], kind), labels, F.lit(True))
    docs = spark.createDataFrame([*rows, odd], kind).union(spark.range(10_000).select(F.lit(5).cast("long"), F.lit(odd[1]), F.lit("en")))
    many = fertility.fit_bands(docs, labels, F.lit(True))
    assert set(once) == set(many) != set()
    for key, own in once.items():
        for name, band in own.items():
            assert math.isclose(band.low, many[key][name].low, rel_tol=1e-6, abs_tol=1e-9) and math.isclose(band.high, many[key][name].high, rel_tol=1e-6, abs_tol=1e-9)


def test_bands_are_those_of_all_good_texts(spark):
    """The ends of a band are the quantiles of all labelled texts, as numpy gives them."""
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(4, 0.3, 7000), np.full(500, 3.0)])
    frame = pd.DataFrame({"id": range(7500), "_lang": "en", "script": "latin", "n_words": 90, "n_repeat_words": 0, "n_tokens": rng.integers(70, 900, 7500), "n_tokens_2": 100})
    for m in fertility.MEASURES:
        frame[m] = values
    bands = fertility.fit_measured(spark.createDataFrame(frame), spark.range(7500))
    x = np.log2(frame.n_tokens)
    for name, curve in (("chars_per_token", np.zeros(3)), ("entropy", np.polyfit(x, values, 2))):
        low, high = np.quantile(values - np.polyval(curve, x), [fertility.TAIL, 1 - fertility.TAIL])
        room, band = fertility.WIDEN * (high - low) + 1e-6, bands["lang", "en"][name]
        assert math.isclose(band.low, low - room, abs_tol=1e-6) and math.isclose(band.high, high + room, abs_tol=1e-6)
