import random
import re
import zlib
from collections import Counter

import pytest
from forumlens.llm import spelling
from forumlens.llm.workspace import Workspace

ROWS = "doc_id long, text string, word string, n int"


def near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            seen[w] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}
    form, count = {}, {}
    for w, n in words.items():
        others = sorted((-words[v], v) for v in words if near(w, v))
        count[w] = len(others)
        form[w] = others[0][1] if others and -others[0][0] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, count[w], words.get(form[w])))
    return out


def varied(rng, base):
    w = list(base)
    p = rng.randrange(len(w))
    how = rng.randrange(3)
    if how == 0:
        w[p] = rng.choice("abcé")
    elif how == 1:
        w.insert(p, rng.choice("abc"))
    else:
        del w[p]
    return "".join(w)


def documents(seed, n=150):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abé") for _ in range(rng.choice([7, 8, 9, 12]))) for _ in range(25)]
    rows = [(1, None), (2, ""), (None, "Kilometre kilometre"), (3, "aaaaaaa aaaaaaaa AAAAAAAAA " * 40)]
    for i in range(n):
        words = [rng.choice(bases[:5]) if rng.random() < 0.7 else rng.choice(bases) for _ in range(40)]
        rows.append((10 + i, " ".join(varied(rng, w) if rng.random() < 0.15 else rng.choice((w, w.upper())) for w in words)))
    return rows + [rows[-1], rows[-1]]


@pytest.mark.parametrize("group_words", [20_000, 3])
def test_matches_brute_force(spark, group_words):
    rows = documents(4)
    df = spark.createDataFrame([(i, t, "clash", 9) for i, t in rows], ROWS).repartition(3)
    got = [tuple(r) for r in spelling.spelling_variants(df, group_words=group_words).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_trie_finds_each_pair_once():
    rng = random.Random(1)
    for size in (2, 30, 200):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(0, 8))) for _ in range(size)})
        got = [tuple(sorted(p)) for p in spelling.one_edit_pairs(words)]
        assert len(got) == len(set(got))
        assert set(got) == {(i, j) for j in range(len(words)) for i in range(j) if near(words[i], words[j])}


def test_hot_groups_grow_linearly(spark):
    rng = random.Random(2)
    made = []
    for n in (300, 1200):
        words = sorted({"abcdef" + "".join(rng.choice("ghijklm") for _ in range(6)) for _ in range(n)})
        df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
        found = spelling.near_words(df, Workspace(spark), group_words=50)
        assert {r.word: r.n_near for r in found.collect()} == {w: k for w in words if (k := sum(near(w, v) for v in words))}
        made.append(len(words))
    assert made[1] > 3 * made[0]


def test_forms_lead_to_the_last_word(spark):
    forms = spark.createDataFrame([(f"w{i:02d}", f"w{i + 1:02d}") for i in range(19)], "word string, form string")
    assert {r.root for r in spelling.roots(forms, Workspace(spark)).collect()} == {"w19"}


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], ROWS)).count() == 0
