import random

import numpy as np
from forumlens.llm import near_dedup as nd
from forumlens.llm.simhash import shingles


def roots(rows):
    """A number for each row, the same for near copies."""
    sets = [set(shingles(t, 5)) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i] == rows[j]
            union = sets[i] | sets[j]
            if same or union and len(sets[i] & sets[j]) >= 0.8 * len(union):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


def brute(rows):
    root, best = roots(rows), {}
    for i, (d, _) in enumerate(rows):
        k = (d is None, d or 0)
        if root[i] not in best or k < best[root[i]][0]:
            best[root[i]] = (k, d)
    return sorted((d for _, d in best.values()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    common = [rng.choice(words) for _ in range(30)]
    rows = [(900, None), (901, ""), (902, " "), (901, ""), (903, "one two"), (904, "ONE  two")]
    n = 0
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([6, 60, 200]))] + common
        for _ in range(rng.choice([1, 2, 5])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 3, 6])):
                own[rng.randrange(len(own))] = rng.choice(words)
            n += 1
            rows.append((500 - n, " ".join(own)))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, content string")
    want = brute(rows)
    for shard_rows in (1024, 16):
        got = nd.near_dedup(df, shard_rows=shard_rows)
        assert got.columns == df.columns
        assert sorted((r.doc_id for r in got.collect()), key=str) == want
    assert nd.near_dedup(df.limit(0)).count() == 0


def test_links_connect_what_is_close():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 9, (400, nd.WORDS)).astype(np.uint64)
    values[300:] = values[:100]
    for radius in (4, 6):
        root = list(range(400))
        for a, b in nd.tree_links(values, np.full(400, radius)):
            assert nd.bits_apart(values[a : a + 1], values[b])[0] <= radius
            root = [root[a] if r == root[b] else r for r in root]
        for i in range(400):
            assert all(root[i] == root[j] for j in np.flatnonzero(nd.bits_apart(values, values[i]) <= radius))


def test_fingerprints_of_similar_sets_are_within_the_radius():
    rng = np.random.default_rng(5)
    worst, least = {}, 256
    for _ in range(4000):
        n = int(rng.choice([4, 5, 8, 9, 12, 20, 24, 30, 50, 300]))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        gone = int(rng.integers(0, n // 5 + 1))
        b = np.append(a[gone:], rng.integers(0, 1 << 63, int(n * 0.25 - gone * 1.25)).astype(np.uint64))
        assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
        x, y = nd.wide_fingerprint(a), nd.wide_fingerprint(b)
        small = min(len(a), len(b)) < nd.SMALL_SET
        worst[small] = max(worst.get(small, 0), nd.bits_apart(x[None], y)[0])
        least = min(least, nd.bits_apart(x[None], nd.wide_fingerprint(rng.integers(0, 1 << 63, n).astype(np.uint64)))[0])
    assert worst[True] < nd.SMALL_RADIUS - 15 and worst[False] < nd.RADIUS - 8 and least > 80


def test_similar_links_equal_brute_force():
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 400, int(rng.integers(1, 60))) for _ in range(30)]
    sets = [np.unique(np.append(rng.choice(b, max(1, int(len(b) * 0.93)), replace=False), rng.integers(0, 400, 2))) for b in base for _ in range(4)]
    root = list(range(len(sets)))
    for a, b in nd.similar_links(sets, 0.8):
        root = [root[a] if r == root[b] else r for r in root]
    want = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(np.intersect1d(x, sets[j])) >= 0.8 * len(np.union1d(x, sets[j])):
                want = [want[i] if r == want[j] else r for r in want]
    pairs = lambda r: {(i, j) for i in range(len(r)) for j in range(i) if r[i] == r[j]}
    assert pairs(root) == pairs(want) and pairs(want)
    assert nd.similar_links([np.array([1, 2]), np.array([3])], 0.8) == []


def test_repeated_phrases_do_not_hide_copies(spark):
    """The fingerprint may be far off where a phrase is repeated; the similarity of the sets decides."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        base = [f"v{rng.randrange(4000)}" for _ in range(200)]
        phrase = [f"u{rng.randrange(4000)}" for _ in range(8)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + phrase * 20))]
    for i in range(200):
        nine = [f"t{rng.randrange(4000)}" for _ in range(9)]
        rows += [(1000 + 2 * i, " ".join(nine)), (1001 + 2 * i, " ".join(nine[:8]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id for r in nd.near_dedup(df).collect()), key=str)
    assert got == brute(rows) and len(got) == 260


def test_names_and_nulls_do_not_clash(spark):
    text = "one two three four five six"
    rows = [(5, None, 1, 2), (None, "5", 3, 4), (6, text, 5, 6), (7, text.upper(), 7, 8), (6, text, 9, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int, doc int")
    got = [tuple(r) for r in nd.near_dedup(df).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[1], rows[2]], key=str) or rows[4] in got and len(got) == 3
