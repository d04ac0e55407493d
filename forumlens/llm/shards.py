"""Hot keys: joins that spread them, and bounded groups of the rows that share one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

HOT_ROWS = 4096
HOT_KEYS = 10_000


def spread_join(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has each key once; no task gets all rows of a hot key.

    ``size`` is the table's count of rows by key, and ``total`` at least their sum. Keys of more than
    ``HOT_ROWS`` rows, or of more than the ``HOT_KEYS``th part of all rows if that is more, are joined by
    broadcast: there are HOT_KEYS of them at most, whatever the size of the input.
    """
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = table.where(F.col(size) > limit)
    if total <= limit or not hot.take(1):
        return rows.join(table, key)
    spread = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(size) <= limit), key)
    return spread.unionByName(others)


def shard_groups(keyed: DataFrame, keys: list[str], row_id: Column, shard_rows: int, work: Workspace, name: str) -> DataFrame:
    """Adds (_i, _j, _own) to the rows of keys with two or more rows; rows of other keys may go or stay.

    Rows of a key with more than ``shard_rows`` rows are split into shards by a hash, and every pair of
    shards becomes a group of its own, so that a group holds about two shards at most and every pair of
    rows of a key meets in some group. _own is the row's own shard; pairs of rows of one shard meet in
    every group of it, so to see each pair once take the pairs of one shard where _i = _j only.

    A key of n rows costs n * n / shard_rows copies: callers give large keys a finer key first, where
    there is one. ``keyed`` must be cheap to read twice (a table). Only keys above ``shard_rows`` are
    joined, by a small table of them that is written first.
    """
    sizes = keyed.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > shard_rows)
    hot = work.table(sizes.coalesce(8), f"{name}-sizes")
    one = F.lit(0).cast("long")
    if not hot.take(1):
        return keyed.withColumns({"_own": one, "_i": one, "_j": one})
    shards = F.ceil(F.coalesce("_n", F.lit(1)) / F.lit(shard_rows)).cast("long")
    total = hot.agg(F.count("*")).first()[0]
    side = F.broadcast(hot) if total <= HOT_KEYS else hot
    return (
        keyed.join(side, keys, "left")
        .withColumn("_shards", shards)
        .withColumn("_own", F.pmod(F.xxhash64(row_id, F.lit(7)), F.col("_shards")))
        .withColumn("_other", F.explode(F.sequence(one, F.col("_shards") - 1)))
        .withColumn("_i", F.least("_own", "_other"))
        .withColumn("_j", F.greatest("_own", "_other"))
        .drop("_n", "_shards", "_other")
    )
