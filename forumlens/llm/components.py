"""Connected components of an edge table, by alternating large-star and small-star steps.

Edges stay distributed: each step groups by node with map-side combining, and the join that sends a
node's smallest neighbour back to its edges spreads the edges of hubs over all tasks.
The number of steps grows with the logarithm of the longest chain. A table of at most ``LOCAL_EDGES``
edges (16 bytes each) needs no steps: one task labels it in memory, with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shards import spread_join
from .workspace import Workspace


LOCAL_EDGES = 500_000


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and the smallest node of each one's component."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _in_one_task(batches):
    ends = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    node, root = labels(*(np.concatenate([e[k] for e in ends] or [np.empty(0, np.int64)]) for k in (0, 1)))
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64())], ["node", "root"])


def _point_to_smallest(pairs: DataFrame, moves: str, include_self: bool, total: int, work: Workspace, name: str) -> DataFrame:
    """For pairs (u, v): an edge from each v that ``moves`` to the smallest node among u and its v."""
    low = pairs.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
    low = work.table(low.select("u", F.least("u", "low").alias("low"), "n"), name)
    joined = spread_join(pairs, low, "u", "n", total)
    edges = joined.where(moves).where("v <> low").select(F.col("v").alias("a"), F.col("low").alias("b"))
    if include_self:
        edges = edges.unionByName(low.where("u <> low").select(F.col("u").alias("a"), F.col("low").alias("b")))
    return edges


def connected_components(edges: DataFrame, work: Workspace, name: str = "cc", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(a, b) long edges -> (node, root) for every node of an edge; root is the component's smallest node.

    Self-loops, repeated edges and either direction are accepted; null ends are dropped. No edges give
    an empty table.
    """
    ends = edges.where("a is not null and b is not null and a <> b")
    current = work.table(
        ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"
    )
    if current.count() <= local_edges:
        return current.coalesce(1).mapInArrow(_in_one_task, "node long, root long")
    seen, step = None, 0
    while True:
        mark = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            current.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        # large star: larger neighbours move to the smallest neighbour
        large = _point_to_smallest(both, "v > u", False, 2 * mark[0], work, f"{name}-low").distinct()
        # small star: smaller neighbours and the node itself move to the smallest
        large = work.table(large, f"{name}-large-star")
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _point_to_smallest(down, "true", True, 2 * mark[0], work, f"{name}-low")
        step += 1
        current = work.table(small.where("a > b").distinct(), f"{name}-{step}")
        work.drop(f"{name}-{step - 1}", f"{name}-low", f"{name}-large-star")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()
