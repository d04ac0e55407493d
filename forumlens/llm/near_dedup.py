"""SimHash near-dedup at a given similarity: one document of each group of near copies stays.

Near copies are linked if the Jaccard similarity of their sets of ``shingle``-word shingles is at
least ``similarity``. 64-bit fingerprints of near copies at 0.8 differ in 5 to 20 bits, which neither
blocks of bits nor a radius tell from chance; so the fingerprints here have 256 bits. At 0.8 a bit
differs with a probability of up to 0.16 in sets of 24 shingles or more, of up to 0.19 in smaller ones;
the radii, 76 and 96 bits, lie 6 and 7 standard deviations above that (a chance of 1e-8 at most), and of
unrelated texts half of the bits differ. The steps are:

1. texts with equal word sequences count as one text;
2. texts that share one of their ``samples`` smallest shingle hashes meet in bounded groups; a BK-tree of
   the group's fingerprints (over distinct shingles) gives the loose links, those within the radius;
3. the loose components are verified by exact similarity, in bounded groups.

Two texts of similarity 0.8 share none of 8 samples with a chance of 0.2 ** 8, about 0.000003, the only
one by which a link can be lost; texts of up to 8 shingles lose none.

No step copies the rows of a large group against each other at once. A group of more than ``shard_rows``
rows is split into shards that all hold the group's ``LEADERS`` as well, so a dense group, of copies of
each other, is connected with a linear number of rows. A group that this leaves in several parts is taken
up again: the rows outside the largest part, if they fit a shard, meet all shards; more of them meet the
rows that share a finer key with them (two shared samples of ``samples + MORE_SAMPLES``; in the
verification, one), which a pair at 0.8 lacks with a chance of 0.2 ** 11. Nothing is capped.

Edge cases: texts without words equal only rows with the same id and text; null ids come last in the
order that decides who stays; rows with the same id and text count as copies; an empty table gives an
empty result; all columns of the documents that stay are passed on unchanged, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shards import spread_join
from .simhash import shingle_hashes, signed
from .workspace import Workspace, row_key

SHINGLE = 5
SIMILARITY = 0.8
WORDS = 4  # of 64 bits in a fingerprint
RADIUS = 76
SMALL_SET = 24
SMALL_RADIUS = 96
SAMPLES = 8
MORE_SAMPLES = 4
LEADERS = 32
SHARD_ROWS = 1024
LEAF = 256


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WORDS words of a fingerprint: a bit is 1 if set in over half of the hashes, spread WORDS ways."""
    out = np.empty(WORDS, np.uint64)
    for k in range(WORDS):
        h = hashes * np.uint64(2 * (0x9E3779B97F4A7C15 * (k + 1) % (1 << 63)) + 1)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[k] = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(h), bitorder="little").view("<u8")[0] if len(h) else 0
    return out


def bits_apart(values: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values ^ one).sum(axis=1, dtype=np.int64)


class WideTree:
    """A BK-tree of fingerprints (n, words): a node's children are keyed by their distance to it.

    Children of up to LEAF values are not divided further; those of a node lie in one array by distance,
    so the edges within the radius are a slice of it. Values can be taken out. Each value has a radius;
    two are near within the larger of theirs.
    """

    def __init__(self, values: np.ndarray, radii: np.ndarray):
        self.values, self.radii, self.left = values, radii, np.ones(len(values), bool)
        self.widest = int(radii.max(initial=0))
        self.root = self._node(np.arange(len(values)))

    def _node(self, own: np.ndarray) -> tuple:
        """(value, distances, values at these distances, {distance: child that is divided})."""
        apart = bits_apart(self.values[own[1:]], self.values[own[0]])
        large = np.flatnonzero(np.bincount(apart) > LEAF)
        large = large[large > 0]  # equal values would only make a chain
        deeper = {d: self._node(own[1:][apart == d]) for d in large.tolist()}
        flat = np.flatnonzero(~np.isin(apart, large))
        flat = flat[np.argsort(apart[flat], kind="stable")]
        return int(own[0]), apart[flat], own[1:][flat], deeper

    def take(self, one: int) -> list[int]:
        """Takes out and returns the values near to one of them."""
        found, stack, value, reach = [], [self.root], self.values[one], self.widest
        while stack:
            at, edges, members, deeper = stack.pop()
            distance = int(np.bitwise_count(self.values[at] ^ value).sum())
            if self.left[at] and distance <= max(self.radii[at], self.radii[one]):
                found.append(at)
            low, high = np.searchsorted(edges, (distance - reach, distance + reach + 1))
            own = members[low:high]
            own = own[self.left[own]]
            if len(own):
                found += own[bits_apart(self.values[own], value) <= np.maximum(self.radii[own], self.radii[one])].tolist()
            stack += [kid for edge, kid in deeper.items() if distance - reach <= edge <= distance + reach]
        self.left[found] = False
        return found


def tree_links(values: np.ndarray, radii: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the fingerprints that are near each other."""
    if len(values) == 2:
        return [(0, 1)] if bits_apart(values[:1], values[1])[0] <= radii.max() else []
    tree, links = WideTree(values, radii), []
    for start in range(len(values)):
        if not tree.left[start]:
            continue
        tree.left[start] = False
        frontier = [start]
        while frontier:
            at = frontier.pop()
            near = tree.take(at)
            links += [(at, i) for i in near]
            frontier += near
    return links


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of sets (distinct hashes) with at least this similarity.

    A set of which more than 1 - similarity stands in no other set is similar to none, so it is left out,
    again and again until no set is.
    """
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    left = np.ones(len(sets), bool)
    while True:
        alone = np.bincount(row[np.bincount(flat)[flat] == 1], minlength=len(sets)) if len(flat) else size
        out = left & (alone > (1 - similarity) * size + 1e-9)
        if not out.any():
            break
        left &= ~out
        kept = left[row]
        row, flat = row[kept], flat[kept]
    start = np.searchsorted(row, np.arange(len(sets) + 1))
    mark, links = np.zeros(int(flat.max(initial=0)) + 1, bool), []
    for first in np.flatnonzero(left).tolist():
        if not left[first]:
            continue
        left[first] = False
        frontier = [first]
        while frontier:
            at = frontier.pop()
            if not left.any():
                return links
            own = flat[start[at] : start[at + 1]]
            mark[own] = True
            common = np.bincount(row[mark[flat]], minlength=len(sets))
            mark[own] = False
            near = np.flatnonzero(left & (common >= similarity * (size[at] + size - common) - 1e-9)).tolist()
            left[near] = False
            links += [(at, i) for i in near]
            frontier += near
    return links


def _links(groups: DataFrame, find) -> DataFrame:
    """(rows of (content, value)) -> (a, b) of the index pairs that ``find`` gives for a group's values."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for members in batch.column(0):
                if len(members) < 2:
                    continue
                own = members.values
                names = own.field("content").to_pylist()
                value = own.field("value")
                values = value.values.to_numpy()[value.offsets[0].as_py() : value.offsets[-1].as_py()].view(np.uint64)
                cuts = np.asarray(value.offsets) - value.offsets[0].as_py()
                for i, j in find(values, cuts):
                    a.append(names[i])
                    b.append(names[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return groups.select("rows").mapInArrow(run, "a long, b long")


def _gathered(rows: DataFrame, keys: list[str], values: DataFrame) -> DataFrame:
    """One row for each group, with the (content, value) of its members."""
    groups = rows.join(values, "content").groupBy(*keys)
    return groups.agg(F.collect_list(F.struct("content", "value")).alias("rows")).where(F.size("rows") > 1)


def _with_leaders(rows: DataFrame, shard_rows: int) -> DataFrame:
    """Rows (content, n) of large keys with a shard; about LEADERS rows of a key are in all its shards."""
    turn = F.pmod(F.xxhash64("content", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    shards = F.ceil(F.col("n") / shard_rows).cast("long")
    own = F.pmod(F.xxhash64("content", F.lit(7)), shards)
    every = F.when(turn < LEADERS / F.col("n"), F.sequence(F.lit(0).cast("long"), shards - 1)).otherwise(F.array(own))
    return rows.withColumn("_shard", F.explode(every))


def _finer_groups(rows: DataFrame, samples: DataFrame, shard_rows: int, work: Workspace, name: str) -> DataFrame:
    """Rows (key, content, root, big, m) of keys in several parts -> (key, finer, _s, _t, content): the
    ``m`` rows outside the key's largest part, ``big``, meet all rows of the key, or if they are many those
    with which they share a finer key.

    A group of more than ``shard_rows`` rows is split: its shards ``_s`` of all rows meet the shards
    ``_t`` of the rows outside the largest part, mostly one, so that copies stay linear.
    """
    apart = (F.col("root") != F.col("big")).alias("apart")
    finer = F.explode(F.filter("keys", lambda k: k != F.col("key"))).alias("finer")
    wide = rows.where(F.col("m") > shard_rows).join(samples, "content")
    wanted = work.table(wide.where("root <> big").select("key", finer).distinct(), f"{name}-wanted")
    own = wide.select("key", "content", apart, finer).join(wanted, ["key", "finer"], "left_semi")
    whole = rows.where(F.col("m") <= shard_rows).select("key", "content", apart, F.lit(0).cast("long").alias("finer"))
    own = work.table(own.select("key", "content", "apart", "finer").unionByName(whole), f"{name}-finer")
    sizes = own.groupBy("key", "finer").agg(F.count("*").alias("n"), F.count_if("apart").alias("m")).where("n > 1")
    sizes = work.table(sizes, f"{name}-sizes")
    zero = F.lit(0).cast("long")
    s, t = (F.ceil(F.col(c) / shard_rows).cast("long") for c in ("n", "m"))
    s = F.when(F.col("n") <= shard_rows, 1).otherwise(s)
    t = F.when(F.col("n") <= shard_rows, 1).otherwise(t)
    at, other = F.pmod(F.xxhash64("content", F.lit(7)), s), F.pmod(F.xxhash64("content", F.lit(3)), t)
    down = F.transform(F.sequence(zero, t - 1), lambda x: F.struct(at.alias("_s"), x.alias("_t")))
    across = F.transform(F.sequence(zero, s - 1), lambda x: F.struct(x.alias("_s"), other.alias("_t")))
    met = F.when(F.col("apart"), F.array_distinct(F.concat(down, across))).otherwise(down)
    return own.join(sizes, ["key", "finer"]).select("key", "finer", "content", F.explode(met).alias("g")).select("key", "finer", "g._s", "g._t", "content")


def _components(rows: DataFrame, values: DataFrame, samples: DataFrame, shard_rows: int, find, work: Workspace, name: str) -> DataFrame:
    """(node, root) of the graph that ``find`` sees among the values of contents that share a key.

    ``rows`` has (key, content), ``values`` (content, value) and ``samples`` (content, keys): of linked
    contents that share a key, those share one of the latter, too.
    """
    counts = work.table(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), f"{name}-counts")
    shared = work.table(spread_join(rows, counts, "key", "n", rows.count()), f"{name}-shared")
    small, large = shared.where(F.col("n") <= shard_rows), shared.where(F.col("n") > shard_rows)
    edges = _links(_gathered(small, ["key"], values), find)
    several = bool(large.take(1))
    if several:
        edges = edges.unionByName(_links(_gathered(_with_leaders(large, shard_rows), ["key", "_shard"], values), find))
    edges = work.table(edges.distinct(), f"{name}-edges")
    nodes = work.table(connected_components(edges, work, name), f"{name}-nodes")
    if several:
        own = large.drop("n").join(nodes.withColumnRenamed("node", "content"), "content", "left")
        own = work.table(own.withColumn("root", F.coalesce("root", "content")), f"{name}-large")
        parts = own.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key")
        parted = parts.agg(F.sum("c").alias("n"), F.max_by("root", "c").alias("big"), (F.sum("c") - F.max("c")).alias("m")).where("m > 0")
        parted = work.table(parted, f"{name}-parted")
        if parted.take(1):
            groups = _finer_groups(spread_join(own, parted, "key", "n", own.count()), samples, shard_rows, work, name)
            more = _links(_gathered(groups, ["key", "finer", "_s", "_t"], values), find)
            edges = work.table(edges.unionByName(more).distinct(), f"{name}-edges-2")
            nodes = work.table(connected_components(edges, work, name), f"{name}-nodes-2")
            work.drop(*(f"{name}-{x}" for x in ("finer", "sizes", "wanted", "edges-2", "nodes")))
        work.drop(f"{name}-large", f"{name}-parted")
    work.drop(f"{name}-counts", f"{name}-shared", f"{name}-edges")
    return nodes


class NearCopies:
    """The near copies of a table.

    ``firsts`` has (content, first), the first row of each content, ``nodes`` (content, root) the contents
    that have near copies.
    """

    def __init__(
        self,
        docs: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        shingle: int = SHINGLE,
        similarity: float = SIMILARITY,
        radius: int = RADIUS,
        small_radius: int = SMALL_RADIUS,
        samples: int = SAMPLES,
        shard_rows: int = SHARD_ROWS,
    ):
        work = self.work = Workspace(docs.sparkSession)
        id_, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
        texts = docs.select(id_.alias("id"), row_key(id_, text).alias("_row"), text.alias("text"))

        def sketch(batches):
            for batch in batches:
                content, fps, keys = [], [], []
                for row, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                    distinct = np.unique(shingle_hashes(text, shingle))
                    content.append(signed(xxhash.xxh64_intdigest(b" ".join(words) if words else row, bool(words))))
                    reach = radius if len(distinct) >= SMALL_SET else small_radius
                    fps.append([*wide_fingerprint(distinct).view(np.int64).tolist(), reach])
                    keys.append(distinct[: samples + MORE_SAMPLES].view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(content, pa.int64()), pa.array(fps, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "_row", "content", "value", "keys"],
                )

        rows = work.table(texts.mapInArrow(sketch, "id long, _row binary, content long, value array<long>, keys array<long>"), "rows")
        place = F.struct(F.col("id").isNull().alias("no_id"), "id", "_row")
        firsts = rows.groupBy("content").agg(F.min(place).alias("first"))
        self.firsts = work.table(firsts, "firsts")
        one = rows.join(self.firsts.select("first._row", "content"), ["_row", "content"]).dropDuplicates(["content"])
        one = work.table(one.select("content", "value", "keys"), "contents")

        def near(values, cuts):
            values = values.reshape(-1, WORDS + 1)
            return tree_links(np.ascontiguousarray(values[:, :WORDS]), values[:, WORDS].astype(np.int64))

        sampled = one.select("content", F.explode(F.slice("keys", 1, samples)).alias("key"))
        loose = _components(sampled, one.select("content", "value"), one.select("content", "keys"), shard_rows, near, work, "loose")
        clusters = loose.select(F.col("node").alias("content"), "root")
        wanted = clusters.join(self.firsts, "content").select(F.col("first._row").alias("_row"), "content")

        def shingle_sets(batches):
            for batch in batches:
                sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64).tolist() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["content", "value"])

        sets = texts.join(wanted, "_row").dropDuplicates(["content"]).select("content", "text")
        sets = work.table(sets.mapInArrow(shingle_sets, "content long, value array<long>"), "sets")

        def similar(values, cuts):
            return similar_links([values[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], similarity)

        of_root = clusters.select(F.col("root").alias("key"), "content")
        keys = one.select("content", F.slice("keys", 1, samples).alias("keys"))
        exact = _components(of_root, sets, keys, max(2, shard_rows // 4), similar, work, "exact")
        self.nodes = exact.select(F.col("node").alias("content"), "root")
        work.drop("contents", "loose-nodes", "loose-nodes-2", "sets")

    def stays(self) -> DataFrame:
        """(_row): of each class the row with the smallest id."""
        best = self.firsts.join(self.nodes, "content", "left").groupBy(F.coalesce("root", "content").alias("class"))
        return self.work.only(best.agg(F.min("first").alias("first")).select("first._row"), "stays")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents that stay: of each group the one with the smallest id."""
    stays = NearCopies(docs, id_col, text_col, **settings).stays()
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")  # so that no name clashes
    own = row_key(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).alias("_row")
    kept = docs.select(whole, own).join(stays, "_row", "left_semi").dropDuplicates(["_row"])
    return kept.select(*(F.col(f"doc.`{c}`") for c in docs.columns))
