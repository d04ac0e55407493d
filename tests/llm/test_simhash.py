import random

import xxhash
from forumlens.llm import simhash

ROWS = "doc_id long, text string, fp string"


def brute(rows, radius=3):
    def fp(t):
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()]
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    at = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                low, high = sorted((at[i], at[j]))
                at = [low if x == high else x for x in at]
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if at[j] == at[i] and rows[j][0] is not None]
        out.append((rows[i][0], simhash.signed(fps[i]), min(ids, default=None)))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "THE"]
    rows = [(7, None), (3, ""), (9, " \t\n"), (None, "a b"), (11, "A  b"), (5, "a b c"), (5, "one two three")]
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([2, 40, 300, 900]))]
        rows.append((100 + 3 * i, " ".join(base)))
        for k in range(rng.choice([0, 1, 3])):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "edited"
            rows.append((1000 + 3 * i + k, " ".join(copy).upper() if k == 2 else "\n".join(copy)))
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], ROWS)
    for shard_rows in (4096, 2):
        got = simhash.simhash_classes(df, shard_rows=shard_rows)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)


def test_empty_table(spark):
    assert simhash.simhash_classes(spark.createDataFrame([], ROWS)).count() == 0


def test_tree_finds_what_a_scan_finds():
    rng = random.Random(1)
    values = [rng.getrandbits(12) for _ in range(400)]
    tree, taken = simhash.BKTree(values), bytearray(400)
    near = sorted(tree.take(77, 2, taken))
    assert near == [i for i, v in enumerate(values) if (v ^ 77).bit_count() <= 2]
    assert tree.take(77, 2, taken) == []


def test_masks_meet_every_close_pair():
    masks = simhash.block_masks(3, 5)
    rng = random.Random(2)
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)
