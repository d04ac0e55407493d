import hashlib
import random

import numpy as np
import pytest
from forumlens.llm import substring_dedup

ROWS = "doc_id long, text string, row string, id int"


def words(text):
    return [w for w in (text or "").encode().split()]


def brute(rows, size=13):
    first = {}
    for i, text in rows:
        w = words(text)
        for k in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[k : k + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return out


def documents(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünï", "the", "the", "\U0001f600"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.choice([11, 13, 14, 30, 80]))] for _ in range(12)]
    rows = [(5, None), (6, ""), (None, " ".join(passages[5])), (7, " \t\r\n "), (8, " ".join(["la"] * 60)), (9, " ".join(["la"] * 40))]
    for i in range(90):
        text = []
        for _ in range(rng.choice([1, 3, 6])):
            text += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
            if rng.random() < 0.2 and text:
                text[rng.randrange(len(text))] = "changed"
        rows.append((rng.randrange(200), rng.choice([" ", "\n", "\x0b "]).join(text)))
    rows += [rows[-1], rows[-1], (300, rows[-1][1]), (301, "x " * 12 + "x"), (302, "x\tx " * 10), (1, " ".join(passages[3] * 3))]
    return rows


def check(spark, rows, size=13, **settings):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], ROWS).repartition(3)
    got = [tuple(r) for r in substring_dedup.substring_dedup(df, size=size, **settings).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, size), key=str)


@pytest.mark.parametrize("settings", [{}, {"hot_rows": 3, "counted_of": 1}, {"size": 3, "anchor": 3, "hot_rows": 10, "counted_of": 1}, {"size": 5, "anchor": 1}])
def test_matches_brute_force(spark, settings):
    check(spark, documents(1), **settings)


def test_passages_of_many_documents(spark):
    rng = random.Random(2)
    common = " ".join(f"c{k}" for k in range(40))
    rows = [(i, f"{common} " + " ".join(f"o{rng.randrange(99)}" for _ in range(20)) if i % 3 else common) for i in range(120)]
    check(spark, rows + [(7, common)] * 50, hot_rows=8, counted_of=1)


def test_spans_name_their_source(spark):
    a = [f"a{k}" for k in range(60)]
    rows = [(1, " ".join(a)), (2, "x y " + " ".join(a[10:50]) + " z"), (3, " ".join(a[30:45]))]
    df = spark.createDataFrame([(i, t, "", 1) for i, t in rows], ROWS)
    got = sorted(tuple(r) for r in substring_dedup.repeated_spans(df).collect())
    assert got == [(2, 2, 42, 1, 10), (3, 0, 15, 1, 30)]


def test_rows_are_settled_whatever_the_batches():
    import pyarrow as pa

    rows = [(k // 7 * 2, k % 5, (k << 32) | 2, None, np.arange(k % 4 + 1, dtype=np.uint32).tobytes()) for k in range(60)]
    rows.sort(key=lambda r: r[:3])
    kinds = [("key", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("anchor", pa.int64()), ("hashes", pa.binary())]
    whole = pa.table(dict(zip([k for k, _ in kinds], zip(*rows))), schema=pa.schema(kinds))
    found = [sorted(r for b in substring_dedup._settle(whole.to_batches(max_chunksize=n)) for r in map(str, b.to_pylist())) for n in (1, 4, 9, 100)]
    assert found[0] == found[1] == found[2] == found[3]


def test_long_text_and_empty_table(spark):
    assert substring_dedup.substring_dedup(spark.createDataFrame([], ROWS)).count() == 0
    long = " ".join(f"n{k}" for k in range(200_000))
    check(spark, [(2, long), (1, " ".join(f"n{k}" for k in range(100, 190_000)))])
