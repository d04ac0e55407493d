"""Benchmark decontamination by greedy string tiling.

Benchmark items are indexed by Karp-Rabin hashes of their runs of ``min_match`` tokens. A document's
own rolling hashes meet them in a bitmap and then a sorted array; matching seeds are compared token
by token, joined to maximal matches along their diagonals, and tiled: the longest match whose tokens
are all unmarked is marked first, and matches that overlap marked tokens are cut down, until none of
``min_match`` tokens is left. A document is contaminated if tiles cover at least ``coverage`` of an
item's tokens, in any order, so reordered passages count. An item of fewer than ``min_match`` tokens is
one seed: it is found where all of it stands.

The seeds meet in a map-side join: the index is broadcast in blocks of about ``block_tokens`` benchmark
tokens, so its size is bounded whatever the size of the benchmark; an item longer than that has a block
of its own. Several blocks take several passes over the texts, each of which writes the matches it
finds by text, not the texts.

Tokens are words between ASCII white space, in lower case, without the signs around them; words of
signs alone are passed over.

Edge cases: null texts and items count as empty; items without tokens match nothing; items with equal
texts match alike; null item ids stay null in the matches; an empty
benchmark or table gives no match; all columns of the documents are passed on unchanged.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import CodeCache, chunks, words
from .workspace import Workspace, row_key

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_TOKENS = 500_000
BITMAP_BITS = 22
PAIRS = 16  # of seeds, for each token and seed, from which diagonals are gone through as a whole

MATCH = "array<struct<item_id: long, coverage: double, tiles: array<struct<item_start: long, doc_start: long, length: long>>>>"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_NO_TOKEN, _UNKNOWN = 0, 1


def bare(word: bytes) -> str:
    text = word.decode("utf-8", "replace").lower()
    start, end = 0, len(text)
    while start < end and not text[start].isalnum():
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return text[start:end]


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of each run of ``size`` ids."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    wide, h = ids.astype(np.uint64), np.zeros(n, np.uint64)
    for k in range(size):
        h = h * _BASE + wide[k : k + n]
    return h ^ (h >> np.uint64(31))


def seed_runs(p: np.ndarray, t: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(item start, doc start, length) of the maximal matches that seeds of ``size`` tokens make up."""
    if not len(p):
        return []
    order = np.lexsort((p, t - p))
    p, t = p[order], t[order]
    first = np.flatnonzero(np.append(True, (np.diff(t - p) != 0) | (np.diff(p) > 1)))[: len(p)]
    last = np.append(first[1:], len(p)) - 1
    return list(zip(p[first].tolist(), t[first].tolist(), (p[last] - p[first] + size).tolist()))


def diagonal_runs(item: np.ndarray, doc: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """The same from the tokens: a pass over the document for each token of the item, for items whose
    seeds repeat so often that pairs of them would be many more than the matches."""
    out, length = [], np.zeros(len(doc) + 1, np.int64)  # of the matches that end before a place
    for i in range(len(item) + 1):
        same = doc == item[i] if i < len(item) else np.zeros(len(doc), bool)
        ends = np.flatnonzero((length >= size) & ~np.append(same, False))
        out += [(i - n, j - n, n) for j, n in zip(ends.tolist(), length[ends].tolist())]
        length[1:], length[0] = np.where(same, length[:-1] + 1, 0), 0
    return out


def tile(runs: list[tuple[int, int, int]], size: int, tokens: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, doc start, length) of an item of ``tokens`` tokens, from its maximal matches.

    Ties go to the earliest place in the item, then in the document.
    """
    heap = [(-n, p, t) for p, t, n in runs]
    heapq.heapify(heap)
    in_item, in_doc, tiles = set(), set(), []
    while heap and tokens - len(in_item) >= size:
        n, p, t = heapq.heappop(heap)
        n = -n
        free = [k for k in range(n) if p + k not in in_item and t + k not in in_doc]
        if len(free) == n:
            in_item.update(range(p, p + n))
            in_doc.update(range(t, t + n))
            tiles.append((p, t, n))
            continue
        start = 0
        for i in range(1, len(free) + 1):
            if i == len(free) or free[i] != free[i - 1] + 1:
                if i - start >= size:
                    heapq.heappush(heap, (start - i, p + free[start], t + free[start]))
                start = i
    return sorted(tiles)


class Seeds:
    """The seeds of one size: their items and places by hash, and a bitmap of the hashes."""

    def __init__(self, size: int, items: dict[int, np.ndarray]):
        self.size = size
        places: dict[int, dict[tuple, dict[int, list[int]]]] = defaultdict(dict)
        for item, own in items.items():
            for p, h in enumerate(rolling(own, size).tolist()):
                places[h].setdefault(tuple(own[p : p + size].tolist()), {}).setdefault(item, []).append(p)
        self.places = {
            h: [(np.array(seed), [(item, np.array(p)) for item, p in found.items()]) for seed, found in by_seed.items()]
            for h, by_seed in places.items()
        }
        self.hashes = np.array(sorted(places), np.uint64)
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[(self.hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] = True

    def meet(self, ids: np.ndarray, row: np.ndarray, met: dict) -> None:
        """Adds (place in ids, places in the item) to ``met`` by row and item."""
        h = rolling(ids, self.size)
        hit = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)])
        if not len(hit) or not len(self.hashes):
            return
        at = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
        hit = hit[self.hashes[at] == h[hit]]
        hit = hit[row[hit] == row[hit + self.size - 1]]
        for t in hit.tolist():
            for seed, found in self.places[int(h[t])]:
                if np.array_equal(seed, ids[t : t + self.size]):
                    for item, p in found:
                        met[int(row[t])][item].append((t, p))


class Index:
    """Items as arrays of token numbers, with their seeds."""

    def __init__(self, items: list[tuple[int | None, str | None]], min_match: int):
        self.vocabulary: dict[str, int] = {"": _NO_TOKEN}
        self.ids, self.items = [], []
        by_size: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
        for number, text in items:
            tokens = [b for b in map(bare, words(text)) if b]
            own = np.array([self.vocabulary.setdefault(b, len(self.vocabulary) + 1) for b in tokens], np.int64)
            if len(own):
                by_size[min(min_match, len(own))][len(self.items)] = own
            self.ids.append(number)
            self.items.append(own)
        self.min_match = min_match
        self.seeds = [Seeds(size, own) for size, own in sorted(by_size.items())]
        self.cache: CodeCache | None = None

    def __getstate__(self):
        return self.__dict__ | {"cache": None}

    def _number(self, word: bytes) -> int:
        return self.vocabulary.get(bare(word), _UNKNOWN)

    def _tiles(self, item: np.ndarray, doc: np.ndarray, seeds: list[tuple[int, np.ndarray]], coverage: float) -> list[tuple[int, int, int]]:
        """Tiles of an item that meets a document, or none if its seeds can't cover enough of it."""
        size = min(self.min_match, len(item))
        covered = np.zeros(len(item) + 1, np.int64)
        for p in {id(p): p for _, p in seeds}.values():  # one array for all places of a seed
            covered[p] += 1
            covered[p + size] -= 1
        if (np.cumsum(covered)[:-1] > 0).sum() < coverage * len(item):
            return []
        if sum(len(p) for _, p in seeds) <= PAIRS * (len(item) + len(seeds)):
            t = np.repeat(np.array([t for t, _ in seeds]), [len(p) for _, p in seeds])
            runs = seed_runs(np.concatenate([p for _, p in seeds]), t, size)
        else:
            runs = diagonal_runs(item, doc, size)
        return tile(runs, size, len(item))

    def match(self, texts: list, coverage: float) -> list[list[dict]]:
        if self.cache is None:
            self.cache = CodeCache(self._number)
        out = []
        for part in chunks(texts):
            split = [words(t) for t in part]
            every = [w for s in split for w in s]
            ids = np.fromiter(map(self.cache.__getitem__, every), np.int64, len(every))
            row = np.repeat(np.arange(len(part)), [len(s) for s in split])
            place = np.concatenate([np.arange(len(s)) for s in split]) if split else np.empty(0, np.int64)
            token = ids != _NO_TOKEN
            ids, row, place = ids[token], row[token], place[token]
            met = defaultdict(lambda: defaultdict(list))
            for seeds in self.seeds:
                seeds.meet(ids, row, met)
            first = np.searchsorted(row, np.arange(len(part) + 1))
            for i in range(len(part)):
                found = []
                a, b = int(first[i]), int(first[i + 1])
                for item, seeds in sorted(met[i].items()) if i in met else ():
                    tiles = self._tiles(self.items[item], ids[a:b], [(t - a, p) for t, p in seeds], coverage)
                    share = sum(x[2] for x in tiles) / len(self.items[item])
                    if tiles and share >= coverage:
                        spans = [{"item_start": p, "doc_start": int(place[a + t]), "length": k} for p, t, k in tiles]
                        found.append({"item_id": self.ids[item], "coverage": share, "tiles": spans})
                out.append(found)
        return out


def _matches(spark, text: Column, index: Index, coverage: float) -> Column:
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf(MATCH)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.match(list(texts), coverage))

    return run(text.cast("string"))


def with_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    out_col: str,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """The documents with ``out_col``: the items that they contain, each with its tiles."""
    spark = docs.sparkSession
    items = benchmark.select(
        F.col(item_id_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text")
    )
    # no more tokens than half of the bytes, rounded up
    total = items.agg(F.coalesce(F.sum((F.octet_length("text") + 1) / 2), F.lit(0.0))).first()[0]
    blocks = max(1, -(-int(total) // block_tokens))
    def index_of(b: int) -> Index:
        rows = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == b).collect()
        return Index(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])), min_match)

    text = F.col(f"`{text_col}`").cast("string")
    if blocks == 1:
        return docs.withColumn(out_col, _matches(spark, text, index_of(0), coverage))
    work, found = Workspace(spark), None
    own = docs.select(row_key(text).alias("key"), text.alias("text"))
    for b in range(blocks):
        hits = own.select("key", _matches(spark, F.col("text"), index_of(b), coverage).alias("m")).where(F.size("m") > 0)
        hits = work.table(hits.dropDuplicates(["key"]), f"block-{b}")
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("m"))).alias("m"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")  # so that no name clashes
    joined = docs.select(whole, row_key(text).alias("key")).join(found, "key", "left")
    kept = (F.col(f"doc.`{c}`") for c in docs.columns if c != out_col)
    return joined.select(*kept, F.coalesce("m", F.array().cast(MATCH)).alias(out_col))
