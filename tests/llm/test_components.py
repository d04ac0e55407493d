import os
import random

from forumlens.llm import shards
from forumlens.llm.components import connected_components
from forumlens.llm.shards import shard_groups
from forumlens.llm.workspace import Workspace, scratch
from pyspark.sql import functions as F


def union_find(pairs):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {x: top(x) for x in root}


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    chain = [(i, i + 1) for i in range(1000, 1120)]
    star = [(5000, 5001 + i) for i in range(60)]
    noise = [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(70)]
    pairs = [*chain, *star, *noise, (7, 7), (None, 3), (4, None), noise[0], noise[0][::-1]]
    rng.shuffle(pairs)
    edges = spark.createDataFrame(pairs, "a long, b long")
    for local_edges in (0, 1000):  # star steps, and one task
        got = connected_components(edges, Workspace(spark), local_edges=local_edges).collect()
        assert {r.node: r.root for r in got} == union_find(pairs) and len(got) == len(union_find(pairs))
        assert connected_components(edges.limit(0), Workspace(spark), local_edges=local_edges).count() == 0


def test_joins_of_hot_keys_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(shards, "HOT_ROWS", 5)
    rows = [(k, i) for k, n in ((1, 40), (2, 3), (3, 6), (4, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long")
    table = df.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top"))
    want = sorted(map(tuple, df.join(table, "k").collect()))
    assert sorted(map(tuple, shards.spread_join(df, table, "k", "n", len(rows)).collect())) == want


def test_every_pair_of_a_key_meets_in_a_bounded_group(spark):
    rows = [(k, i) for k, n in ((1, 40), (2, 3), (3, 1)) for i in range(n)]
    work = Workspace(spark)
    df = work.table(spark.createDataFrame(rows, "k long, i long"), "rows")
    groups = {}
    for r in shard_groups(df, ["k"], F.col("i"), 8, work, "g").collect():
        groups.setdefault((r.k, r._i, r._j), []).append((r.i, r._own))
    met = {(k, a[0], b[0]) for (k, i, j), g in groups.items() for a in g for b in g if a < b and (i == j or a[1] != b[1])}
    met = {(k, min(a, b), max(a, b)) for k, a, b in met}
    assert met == {(k, a, b) for k, n in ((1, 40), (2, 3)) for a in range(n) for b in range(a + 1, n)}
    assert max(len(g) for g in groups.values()) < 40


def test_scratch_tables_are_deleted(spark):
    with scratch():
        work = Workspace(spark)
        df = work.table(spark.range(3).toDF("id"), "a")
        assert df.count() == 3 and os.path.isdir(f"{work.root.removeprefix('file:')}/a")
    assert not os.path.isdir(work.root.removeprefix("file:"))
