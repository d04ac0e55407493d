import random
import time

from forumlens.llm import decontamination as dc


def greedy(item, doc, size):
    """Greedy string tiling as published: all maximal matches, longest first."""
    a, b, total = [False] * len(item), [False] * len(doc), 0
    while True:
        best = 0
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best:
                    best, at = k, (i, j)
        if best < size:
            return total
        i, j = at
        for k in range(best):
            a[i + k] = b[j + k] = True
        total += best


def test_tiles_cover_what_plain_tiling_covers():
    rng = random.Random(9)
    for _ in range(150):
        item = [rng.choice("abcd") for _ in range(rng.randrange(3, 25))]
        doc = [rng.choice("abcd") for _ in range(rng.randrange(3, 40))]
        cut = rng.randrange(len(item))
        doc[5:5] = item[cut:] + ["x"] + item[:cut]
        index = dc.Index([(1, " ".join(item))], 3)
        found = index.match([" ".join(doc)], 0.0)[0]
        want = greedy(item, doc, 3) / len(item)
        assert abs((found[0]["coverage"] if found else 0.0) - want) < 1e-9


def test_reordered_and_edges(spark):
    rng = random.Random(2)
    item = [f"word{i}" for i in range(40)]
    filler = lambda n: [f"z{rng.randrange(500)}" for _ in range(n)]
    swapped = filler(30) + item[20:] + filler(9) + item[:20] + filler(30)
    rows = [(1, " ".join(swapped)), (2, " ".join(filler(100))), (3, None), (4, ""), (5, " ".join(item).upper() + "!"), (5, " ".join(item)),
            (6, " ".join(filler(20000) + item)), (7, " ".join(item[:15])), (None, "- ".join(item))]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(10, " ".join(item)), (None, None), (11, "too short"), (12, "")], "item_id long, text string")
    for block_tokens in (500_000, 40):
        got = dc.with_matches(docs, items, "found", block_tokens=block_tokens).collect()
        assert sorted((r.doc_id or 0) for r in got if r.found) == [0, 1, 5, 5, 6]
        one = next(r for r in got if r.doc_id == 1).found[0]
        assert one.item_id == 10 and one.coverage == 1.0
        assert sorted((t.item_start, t.doc_start, t.length) for t in one.tiles) == [(0, 59, 20), (20, 30, 20)]
    assert not any(r.found for r in dc.with_matches(docs, items.limit(0), "found").collect())
    assert dc.with_matches(docs.limit(0), items, "found").count() == 0


def test_short_items_and_repeated_seeds():
    index = dc.Index([(1, "yes it is"), (2, "..."), (3, "a b c d e f")], 5)
    found = index.match(["so yes, it is so", "yes it was", "yes it", "a b c d e", ""], 0.5)
    assert [[m["item_id"] for m in f] for f in found] == [[1], [], [], [3], []]
    rng = random.Random(4)
    for _ in range(200):
        item, doc = ([rng.choice("ab") for _ in range(rng.randrange(1, n))] for n in (14, 40))
        size = min(3, len(item))
        seeds = [(p, t) for p in range(len(item) - size + 1) for t in range(len(doc) - size + 1) if item[p : p + size] == doc[t : t + size]]
        a, b = (dc.np.array([ord(c) for c in x]) for x in (item, doc))
        p, t = (dc.np.array([s[k] for s in seeds], int) for k in (0, 1))
        assert sorted(dc.seed_runs(p, t, size)) == sorted(dc.diagonal_runs(a, b, size))
        got = dc.Index([(1, " ".join(item))], 3).match([" ".join(doc)], 0.0)[0]
        assert (got[0]["coverage"] if got else 0.0) == greedy(item, doc, size) / len(item)


def test_equal_tokens_take_no_pairs():
    index = dc.Index([(1, "z " * 200)], 5)
    start = time.monotonic()
    assert index.match(["z " * 200_000], 0.5)[0][0]["coverage"] == 1.0
    assert time.monotonic() - start < 20


def test_blocks_give_what_one_block_gives(spark):
    rows = [(i, t, i) for i, t in enumerate(["a b c d e f g", "a b c d e f g", None, "", "h i j k l m a b c d e f"])]
    docs = spark.createDataFrame(rows, "key long, text string, doc long")
    items = spark.createDataFrame([(1, "a b c d e f"), (2, "h i j k l m"), (3, "g"), (None, "l m")], "item_id long, text string")
    plain = lambda df: sorted((r.key, r.text or "", r.doc, sorted((m.item_id or 0, m.coverage) for m in r.m)) for r in df.collect())
    one, many = (dc.with_matches(docs, items, "m", block_tokens=n) for n in (500_000, 3))
    assert one.columns == many.columns and plain(one) == plain(many)
    assert [[i for i, _ in r[3]] for r in plain(one)] == [[1, 3], [1, 3], [], [], [0, 1, 2]]
