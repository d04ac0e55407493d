import hashlib
import math
import random

import pytest
from forumlens.llm import vector_codes

ROWS = "vec_id long, embedding array<double>, label int, code string"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2])))
    d = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    whole = [[math.floor(4096 * x) for x in v] + [0] * (parts * d - len(v)) for _, v, _ in kept]
    cut = [[w[p * d : (p + 1) * d] for p in range(parts)] for w in whole]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, own) if o == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    out = []
    for (i, _, y), c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(s for s, _ in found), y))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, c, e, sum(f for _, _, f, z in out if z == y), sha) for i, c, e, y in out]


def check(spark, rows):
    df = spark.createDataFrame([(i, v, y, "clash") for i, v, y in rows], ROWS).repartition(3)
    got = [tuple(r) for r in vector_codes.vector_codes(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_matches_plain_lloyd_rounds(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 0.2) for _ in range(32)] for _ in range(7)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], rng.choice([1, 2, None])) for i in range(300)]
    rows += [(1000 + i, [None if k == i else 0.1 for k in range(32)], 1) for i in range(2)]
    rows += [(2000, None, 1), (2001, [math.nan] * 32, 1), (2002, [math.inf] * 32, 3), (None, [0.3] * 32, 3), (4, [0.2] * 32, None)]
    check(spark, rows)


def test_ties_repeats_and_short_vectors(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-0.25, 0.25]) for _ in range(rng.choice([5, 9, 16]))], 0) for i in range(120)]
    rows += [rows[3], rows[3], (200, [], 0)]
    check(spark, rows)


def test_few_rows_and_large_components(spark):
    check(spark, [(2, [1.0, -2.5, 3.25], 1), (1, [0.5, 0.5, 0.5], None)])
    check(spark, [(i, [300_000.0 * ((-1) ** i), float(i), 70_000.5 + i % 3, 0.1], i % 2) for i in range(40)])


def test_nothing_kept(spark):
    assert vector_codes.vector_codes(spark.createDataFrame([], ROWS)).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1, "")], ROWS)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_bounds_give_what_a_full_scan_gives(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    x = rng.integers(-30, 30, (500, 3))
    books = [rng.integers(-30, 30, (16, 3)).tolist()]
    groups = vector_codes.grouped(books[0], 4)
    code, _, bounds = vector_codes.Codebook(books[0], groups, None, np.int64).start(x)
    for step in range(5):
        books.append([[v + int(rng.integers(-2, 3)) for v in e] for e in books[-1]])
        book = vector_codes.Codebook(books[-1], groups, books[-2], np.int64)
        code, bounds = book.assign(x, code, bounds)
        plain, best, _ = book.start(x)
        assert (code == plain).all() and (bounds[:, 0] ** 2 >= best).all()
