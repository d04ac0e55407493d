import random

import numpy as np
from forumlens.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, n):
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        kind = rng.randrange(3)
        s = s[:i] + ("" if kind == 0 else rng.choice("abé")) + s[i + (kind != 1) :]
    return s


def test_banded_distance():
    rng = random.Random(0)
    for _ in range(6000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 14)))
        b = edited(rng, a, rng.randrange(0, 5))
        for k in (0, 1, 2, 3):
            assert ld.within_edits(a, b, k) == (distance(a, b) <= k), (a, b, k)


def test_close_lines_share_a_key():
    rng = random.Random(1)
    for k in (1, 2, 3):
        for _ in range(2000):
            a = "".join(rng.choice("ab") for _ in range(rng.randrange(10, 30)))
            b = edited(rng, a, k)
            if len(b) < 8 or distance(a, b) > k:
                continue
            x, y = (row.tolist() for row in ld.keys([a, b], k))
            assert set(x[: k + 1]) & set(y) or set(y[: k + 1]) & set(x)
            assert any(p == q for p, q in zip(ld.class_keys(a, k), ld.class_keys(b, k)))
            s = ld.sketches([a, b])
            assert ld.sketch_distance(s[:1], s[1:])[0] <= 2 * k


def brute(rows, k, min_chars):
    lines = sorted({s for _, t in rows for _, s in ld.document_lines(t, min_chars)})
    root, links = {s: s for s in lines}, {s: 0 for s in lines}
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) <= k and distance(a, b) <= k:
                links[a] += 1
                links[b] += 1
                old, new = root[a], root[b]
                for s in lines:
                    root[s] = new if root[s] == old else root[s]
    return root, links


def corpus():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcd efg") for _ in range(rng.randrange(16, 40))).strip().ljust(16, "x") for _ in range(25)]
    dense = [f"this is page {i} of this long book" for i in range(40)]
    rows = [(None, None), (1, ""), (2, "short\nshort\n\n"), (3, "x" * 5000 + "\n" + "x" * 5001)]
    for i in range(40):
        own = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2])) for _ in range(rng.randrange(1, 6))]
        own += [rng.choice(dense), "  " + rng.choice(dense) + " "]
        rows.append((100 - i, "\n".join(own)))
    return [*rows, rows[-1], (None, rows[-2][1]), (7, "😀 " * 20 + "\n" + "😀 " * 19 + "é ")]


def test_classes_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, line int")
    for k, shard_rows in ((1, 512), (2, 3), (2, 512)):
        root, links = brute(rows, k, 16)
        got = ld.LineClasses(df, threshold=k, shard_rows=shard_rows).by_document().collect()
        assert len(got) == len(rows)
        name = {}
        by_key = {}
        for (i, t) in rows:
            own = [s for _, s in ld.document_lines(t, 16)]
            by_key.setdefault((i, len(own), tuple(links[s] for s in own)), []).append(own)
        for r in got:
            options = by_key[(r.id, r.n_lines, tuple(r.links))]
            if len(options) == 1:
                for s, c in zip(options[0], r.classes):
                    assert name.setdefault(root[s], c) == c
        assert len(set(name.values())) == len(name)


def test_removal(spark):
    a, b, c = "the first long line of all", "the second long line of all", "another thing altogether here"
    rows = [(1, f"{a}\n{b}\nhi"), (2, f"{a}!\n{c}\n\nhi"), (3, f" {a}\n"), (4, None), (5, "hi"), (6, f"{b}\n{b}\nnew text stands here too")]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, pos string, line int")
    got = {r.doc_id: r.text for r in ld.remove_repeated_lines(df).collect()}
    assert got == {1: f"{a}\n{b}\nhi", 2: f"{c}\n\nhi", 4: None, 5: "hi", 6: "new text stands here too"}
    assert ld.remove_repeated_lines(df).columns == df.columns
    assert ld.remove_repeated_lines(df.limit(0)).count() == 0


def test_short_lines_have_classes_by_equality(spark):
    long = "a line that is long enough to be joined"
    rows = [(1, f"Les.\n{long}\nLez."), (2, " Les. \nHaanth."), (3, f"Les.\n{long}"), (4, "\n \nHaanth.\nHaanth.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r for r in ld.LineClasses(df, short_lines=True).by_document().collect()}
    assert {i: (r.n_lines, r.n_repeated, r.n_linked) for i, r in got.items()} == {1: (3, 0, 0), 2: (2, 1, 0), 3: (2, 2, 0), 4: (2, 2, 0)}
    assert got[1].classes[0] == got[2].classes[0] == got[3].classes[0] != got[1].classes[2]
    assert got[2].classes[1] == got[4].classes[0] == got[4].classes[1]
    left = {r.doc_id: r.text for r in ld.remove_repeated_lines(df, short_lines=True).collect()}
    assert left == {1: rows[0][1], 2: "Haanth."}


def test_default_threshold_covers_a_changed_word(spark):
    a, b = "there stood the old stes eare of the house and all", "there stood the old stes aree of the house, and all"
    assert distance(a, b) == 3
    df = spark.createDataFrame([(1, a), (2, b), (3, a.replace("stood", "lay by"))], "doc_id long, text string")
    got = {r.id: r for r in ld.LineClasses(df).by_document().collect()}
    assert got[1].classes == got[2].classes != got[3].classes and got[2].n_repeated == 1


def test_hot_keys_lose_no_pair():
    """Many lines under one key: passed on from a bucket that grows too large, then told apart by classes."""
    rng = np.random.default_rng(0)
    entries = np.zeros(4000, ld.PACKED)
    entries["low"] = np.where(rng.random(4000) < 0.5, 8, rng.integers(0, 900, 4000) * 2) | rng.integers(0, 2, 4000)
    entries["line"] = rng.integers(0, 600, 4000)
    whole = ld.distinct_entries(entries, set())
    keep, large = ld.partners(whole, 3, 50, set())
    assert set(whole["low"][large] >> 1) == {4} and keep[large].all()
    assert len(set(zip(whole["low"] >> 1, whole["line"]))) == len(whole)
    one = ld.distinct_entries(entries[:1], {int(entries["low"][0]) >> 1})
    assert len(one) == 1 and not len(ld.distinct_entries(entries[:1], set())) and not len(ld.distinct_entries(entries[:0], set()))


def test_names_and_nulls_do_not_clash(spark):
    line = "a line that is long enough to be joined"
    rows = [(5, None, 1, 2), (None, "5", 3, 4), (6, f"{line}\n\u3000", 5, 6), (7, f"{line}\n\u3000", 7, 8), (7, f"{line}\n\u3000", 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row int, _drops int")
    got = {tuple(r) for r in ld.remove_repeated_lines(df, short_lines=True).collect()}
    assert got == {rows[0], rows[1], rows[2]}
    assert [len(r.classes) for r in ld.LineClasses(df).by_document().where("id = 7").collect()] == [1, 1]


def test_near_copies_keep_what_they_share(spark):
    rng = random.Random(3)
    line = lambda: " ".join(f"word{rng.randrange(500)}" for _ in range(12))
    body, passage = [line() for _ in range(20)], line()
    near = body[:19] + [line()]
    other = [line() for _ in range(9)] + [passage, body[3]]
    rows = [(1, "\n".join(body)), (2, "\n".join(near)), (3, "\n".join(other)), (4, "\n".join([*near, passage])), (5, passage), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in ld.remove_repeated_lines(docs, short_lines=True, near_copies=True).collect()}
    assert got[1] == rows[0][1] and got[2] == rows[1][1]
    assert got[3] == "\n".join(other[:10])
    assert got[4] == "\n".join(near)
    assert 5 not in got
    plain = {r.doc_id: r.text for r in ld.remove_repeated_lines(docs, short_lines=True).collect()}
    assert plain[2] == near[19] and 4 not in plain
