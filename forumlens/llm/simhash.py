"""SimHash near-duplicates: fingerprints linked through BK-trees of bounded shards.

``simhash_classes`` computes a 64-bit fingerprint of every whole text, links fingerprints that
differ in at most ``radius`` bits, and labels each document with its connected component.

Linking: two fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of ``blocks``
bit blocks, so every choice of that many blocks gives a key under which such a pair must meet
(pigeonhole; the result doesn't depend on ``blocks``). Fingerprints that share a key form a shard,
held in a BK-tree whose children are keyed by their Hamming distance to the parent; a search follows
the edges within the radius only. Hot keys are split into pairs of bounded shards. A search takes
what it finds out of the tree, and only the edges of a spanning forest leave a task, so a dense group
costs a linear number of rows.

Edge cases: null or word-less texts have fingerprint 0 and link like any other; equal texts share a
fingerprint; a null id takes part in its component but never is its smallest id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shards import shard_groups, spread_join
from .workspace import Workspace

SEED = 42
_U64 = (1 << 64) - 1


def shingles(text: str | None, size: int) -> list[bytes]:
    """ASCII-lower-cased words split at ASCII white space, joined in runs of ``size``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    parts = shingles(text, size)
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))


def majority_bits(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_in = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > len(hashes), bitorder="little").tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed long."""

    def run(batches):
        for batch in batches:
            fps = [signed(majority_bits(shingle_hashes(t, shingle))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


class BKTree:
    """Values by Hamming distance: a node's children are keyed by their distance to it."""

    __slots__ = ("values", "children", "left", "parent", "edge")

    def __init__(self, values):
        self.values = list(values)
        n = len(self.values)
        self.children: list[dict[int, int]] = [{} for _ in range(n)]
        self.left = [1] * n  # values not yet taken at or below each node
        self.parent = [-1] * n
        for i in range(1, n):
            self._insert(i)

    def _insert(self, i: int) -> None:
        at, value = 0, self.values[i]
        while True:
            self.left[at] += 1
            distance = (self.values[at] ^ value).bit_count()
            child = self.children[at].get(distance)
            if child is None:
                self.children[at][distance] = i
                self.parent[i] = at
                return
            at = child

    def take(self, value: int, radius: int, taken: bytearray) -> list[int]:
        """Takes out and returns the nodes within the radius of a value."""
        found, stack = [], [0] if self.left[0] else []
        while stack:
            at = stack.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius and not taken[at]:
                taken[at] = 1
                found.append(at)
                up = at
                while up >= 0:
                    self.left[up] -= 1
                    up = self.parent[up]
            kids = self.children[at]
            for edge in range(max(0, distance - radius), distance + radius + 1):
                kid = kids.get(edge)
                if kid is not None and self.left[kid]:
                    stack.append(kid)
        return found


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the graph of values within the radius."""
    if len(values) == 2:
        return [(0, 1)] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree, taken, links = BKTree(values), bytearray(len(values)), []
    for start in range(len(values)):
        if taken[start]:
            continue
        frontier = tree.take(values[start], 0, taken)
        links += [(start, i) for i in frontier if i != start]
        while frontier:
            at = frontier.pop()
            near = tree.take(values[at], radius, taken)
            links += [(at, i) for i in near]
            frontier += near
    return links


def block_masks(radius: int, blocks: int) -> list[int]:
    """A mask for each choice of ``blocks - radius`` of the bit blocks, as signed longs."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("0 <= radius < blocks <= 64 is needed")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [signed(sum(c) & _U64) for c in combinations(parts, blocks - radius)]


def link_fingerprints(
    fps: DataFrame, work: Workspace, radius: int = 3, blocks: int = 5, shard_rows: int = 4096, name: str = "links"
) -> DataFrame:
    """Distinct fingerprints (fp long) -> (a, b): edges that connect all within the radius."""
    masks = block_masks(radius, blocks)
    keyed = fps.select(
        "fp",
        F.explode(
            F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)))
        ).alias("key"),
    ).select("fp", "key.t", "key.k")
    groups = (
        shard_groups(keyed, ["t", "k"], F.col("fp"), shard_rows, work, name)
        .groupBy("t", "k", "_i", "_j")
        .agg(F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
        .select("members")
    )

    def link(batches):
        for batch in batches:
            a, b = [], []
            for members in batch.column(0).to_pylist():
                values = [v & _U64 for v in members]
                for i, j in spanning_links(values, radius):
                    a.append(members[i])
                    b.append(members[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return groups.mapInArrow(link, "a long, b long")


def simhash_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    radius: int = 3,
    blocks: int = 5,
    shard_rows: int = 4096,
) -> DataFrame:
    """(id, fp, class_id): class_id is the smallest id of the fingerprint's connected component."""
    work = Workspace(docs.sparkSession)
    rows = work.table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = work.table(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "distinct")
    nodes = work.table(connected_components(link_fingerprints(distinct, work, radius, blocks, shard_rows), work), "nodes")
    linked = work.table(nodes.join(distinct, nodes.node == distinct.fp).select("fp", "root", "low"), "linked")
    lows = linked.groupBy("root").agg(F.min("low").alias("class_low"), F.count("*").alias("size"))
    labels = spread_join(linked, lows, "root", "size", linked.count()).select(F.col("fp").alias("linked_fp"), "class_low")
    # only linked fingerprints need the join; the class of any other is its own smallest id
    classes = distinct.join(labels, F.col("fp") == F.col("linked_fp"), "left").select(
        "fp", "n", F.coalesce("class_low", "low").alias("class_id")
    )
    classes = work.table(classes, "classes")
    work.drop("distinct", "nodes", "linked", "links-sizes")
    return spread_join(rows, classes, "fp", "n", rows.count()).select("id", "fp", "class_id")


def fingerprint_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
