"""Spelling variants: words at one edit from each other, found by merging tries with one error.

Words that differ by one inserted, deleted or replaced character agree on their first half or on their
last: with s the smaller length, the edit lies at or after place s // 2, or at or before it. Every word is
therefore put under the halves that it has for its own length and for one less, and a pair meets in one
group of words of lengths s and s + 1.

A group is searched as an errata trie. The words, in order, are a trie; at each node the child with the most
words is heavy and the others are light. The light subtrees are merged with one character replaced (among
each other and into the heavy one) or skipped, small into large: each word of a light subtree is put where it
would be without the character, and where a word ends there already, that is a pair. A word lies in at most
log2(n) light subtrees, so n words cost n log n look-ups, and a pair is found once, at the node where it parts.

Groups of more than ``GROUP_WORDS`` words (or the 10,000th part of all rows, if that is more) are not
gathered: their words are spread over keys with one character left out, whose groups are no larger than
the alphabet. A group's task returns a row for each word, not for each pair.

Edge cases: null texts have no words, a null id counts as empty text, repeated rows count as often as they
stand; of equally frequent near words the first in code-point order is the form. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shards import HOT_KEYS
from .workspace import Workspace

RUN = r"([A-Za-zÀ-ÿ]+)"
MIN_CHARS, MIN_COUNT, TIMES = 7, 2, 10
GROUP_WORDS = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = 31, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT
) -> DataFrame:
    """(word, n): the letter runs of all texts, A-Z in lower case. With ``damage`` a run whose crc32 of
    ``id:run`` it divides loses the character at that crc's place."""
    ids = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(ids.alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(1))).alias("run"))
    word = F.translate("run", _UPPER, _LOWER)
    if damage:
        runs = runs.select(word.alias("word"), F.crc32(F.concat("id", F.lit(":"), word).cast("binary")).alias("h"))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        word = F.when(F.col("h") % damage == 0, cut).otherwise(F.col("word"))
    rows = runs.select(word.alias("word")).where(F.length("word") >= min_chars)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def halves(word: Column, least: int) -> Column:
    """The keys of a word, structs (s, side, part), for its own length and for one less."""
    length = F.length(word)
    keys = []
    for s in (length, length - 1):
        half = (s / 2).cast("int")
        keys += [F.struct(s.alias("s"), F.lit("P").alias("side"), F.left(word, half).alias("part"))]
        keys += [F.struct(s.alias("s"), F.lit("S").alias("side"), F.right(word, s - half).alias("part"))]
    return F.filter(F.array(*keys), lambda k: k["s"] >= least)


def left_out() -> Column:
    """For a row of a hot group: keys with one character of its open half left out, kept apart as 'R' for
    replacement (with the place) and 'D' for the shorter word itself."""
    w, s, half = F.col("word"), F.col("s"), (F.col("s") / 2).cast("int")
    low = F.when(F.col("side") == "P", half).otherwise(F.lit(0))
    high = F.when(F.col("side") == "P", F.length(w) - 1).otherwise(F.when(F.length(w) == s, half - 1).otherwise(half))

    def without(p: Column) -> Column:
        return F.concat(F.substr(w, F.lit(1), p), F.substr(w, p + 2))

    places = F.sequence(low, high)
    whole = F.array(F.concat(F.lit("D"), w))
    replaced = F.transform(places, lambda p: F.concat(F.lit("R"), p.cast("string"), F.lit(":"), without(p)))
    shorter = F.array_distinct(F.transform(places, lambda p: F.concat(F.lit("D"), without(p))))
    return F.when(F.length(w) == s, F.concat(whole, replaced)).otherwise(shorter)


def one_edit_pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """Index pairs of the sorted, distinct words that are one edit apart, each once."""
    index = {w: i for i, w in enumerate(words)}
    stack = [(0, len(words), 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2:
            continue
        first, last = words[lo], words[hi - 1]
        while depth < len(first) and first[depth] == last[depth]:  # a chain of nodes with one child
            depth += 1
        ends = len(first) == depth
        children, at = [], lo + ends
        while at < hi:
            char, end = words[at][depth], at + 1
            while end < hi and words[end][depth] == char:
                end += 1
            children.append((at, end))
            at = end
        children.sort(key=lambda c: c[0] - c[1])
        heavy = children[0]
        head = words[heavy[0]][: depth + 1]
        if ends and (j := index.get(head)) is not None:
            yield lo, j
        merged: dict[str, list[int]] = {}
        for a, b in children[1:]:
            mine = []
            for i in range(a, b):
                word = words[i]
                rest = word[depth + 1 :]
                if (j := index.get(head + rest)) is not None:  # replaced by the heavy character
                    yield i, j
                if rest[:1] != word[depth] and (j := index.get(word[:depth] + rest)) is not None:  # skipped; else they part later
                    yield i, j
                if (j := index.get(head + word[depth:])) is not None:  # the heavy word skips its character
                    yield i, j
                for j in merged.get(rest, ()):  # replaced by the character of another light subtree
                    yield i, j
                mine.append((rest, i))
            for rest, i in mine:
                merged.setdefault(rest, []).append(i)
        stack += children and [(a, b, depth + 1) for a, b in children]


def _fine_pairs(key: str, words: list[str]) -> Iterator[tuple[int, int]]:
    if key[0] == "R":
        yield from ((i, j) for i in range(len(words)) for j in range(i))
    else:  # the word that the key is, with those that have one character more
        short = next((i for i, w in enumerate(words) if w == key[1:]), None)
        if short is not None:
            yield from ((short, j) for j in range(len(words)) if j != short)


def _near(batches):
    """Rows sorted by (key, word) -> for each word of a group its near words there: how many, and the best."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(6)))

    out: list[tuple] = []
    for _, group in groupby(rows(), key=lambda r: r[:4]):
        members = list(group)
        if len(members) < 2:
            continue
        s, side, part, fine = members[0][:4]
        words, counts = [m[4] for m in members], [m[5] for m in members]
        if fine is not None:
            pairs = _fine_pairs(fine, words)
        elif side == "S":  # what the halves have in common is in front
            order = sorted(range(len(words)), key=lambda i: words[i][::-1])
            words, counts = [words[i] for i in order], [counts[i] for i in order]
            pairs = one_edit_pairs([w[::-1] for w in words])
        else:
            pairs = one_edit_pairs(words)
        near, best = [0] * len(words), [-1] * len(words)
        half = s // 2
        for i, j in pairs:
            u, v = words[i], words[j]
            if min(len(u), len(v)) != s or side == "S" and u[:half] == v[:half]:
                continue  # another group's pair
            for a, b in ((i, j), (j, i)):
                near[a] += 1
                c = best[a]
                if c < 0 or (-counts[b], words[b]) < (-counts[c], words[c]):
                    best[a] = b
        out += [(w, k, words[b], counts[b]) for w, k, b in zip(words, near, best) if k]
        if len(out) >= 20_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["word", "near", "best", "best_n"])


def near_words(words: DataFrame, work: Workspace, least: int = MIN_CHARS, group_words: int = GROUP_WORDS) -> DataFrame:
    """Distinct (word, n) -> (word, n_near, best, best_n) of the words that have near words; best is the most
    frequent of them. ``least`` is the smallest length of a word."""
    keyed = work.table(words.select("word", "n", F.explode(halves(F.col("word"), least)).alias("k")).select("k.*", "word", "n"), "halves")
    limit = max(group_words, keyed.count() // HOT_KEYS)
    key = ["s", "side", "part"]
    hot = work.table(keyed.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).drop("_n").coalesce(1), "hot")
    fine = F.lit(None).cast("string")
    rows = keyed.withColumn("fine", fine)
    if hot.take(1):  # HOT_KEYS of them at most, by the limit
        held = keyed.join(F.broadcast(hot), key)
        rows = keyed.join(F.broadcast(hot), key, "left_anti").withColumn("fine", fine)
        rows = rows.unionByName(held.withColumn("fine", F.explode(left_out())))
    rows = rows.select(*key, "fine", "word", "n")
    order = [*key, "fine", "word"]
    found = rows.repartition(*key, "fine").sortWithinPartitions(*order).mapInArrow(_near, "word string, near long, best string, best_n long")
    first = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("b")).select("word", "n_near", "b.best", (-F.col("b.m")).alias("best_n"))


def roots(forms: DataFrame, work: Workspace) -> DataFrame:
    """(word, form) -> (word, root): the last word that the forms lead to.

    A form is at least twice as frequent as its word, so a way has no more than 62 steps and doubling the
    steps ends after 6 rounds."""
    current = work.table(forms.select("word", F.col("form").alias("root")), "roots-0")
    for k in range(1, 8):
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if current.join(onward, "root", "left_semi").isEmpty():
            break
        step = current.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        current = work.table(step, f"roots-{k}")
    return current


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = 31, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
    times: int = TIMES, group_words: int = GROUP_WORDS,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a word's form is its most frequent near word, if that is at
    least ``times`` as frequent; its root is where following forms ends."""
    if times < 2:
        raise ValueError("times must be at least 2")
    work = Workspace(docs.sparkSession)
    words = work.table(counted_words(docs, id_col, text_col, damage, min_chars, min_count), "words")
    near = near_words(words, work, max(1, min_chars), group_words)
    known = F.col("best_n") >= F.col("n") * times
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(known, F.col("best")).alias("form"), F.when(known, F.col("best_n")).alias("form_n")
    )
    rows = work.only(rows, "rows")
    ends = roots(rows.where("form is not null"), work)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
