"""Which articles enter or leave the analysis queue while their comments and analyses arrive.

An event is (article_id, at, weight) for a comment, whenever it was written, or (article_id, at, null) for an
analysis. An article is wanted once its summed weight reaches the threshold, and stale once it has a comment
after its last analysis and ``gap`` seconds have gone by since. ``queue_changes`` says so as it happens, from a
state for each article; ``queue_status`` says the same of all events at once.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

THRESHOLD, GAP, TTL, WIDTH = 20, 3600, 7 * 86400, 512
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "article_id long, net long, event string, number long"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
#: a bucket's articles as columns of equal length, in order of their ids; _NONE for no comment or no analysis yet
_STATE = "article_id array<long>, net array<long>, number array<long>, pushed_at array<long>, analysed_at array<long>, told array<long>, seen_ms array<long>"
_COLUMNS = ("article_id", "net", "number", "pushed_at", "analysed_at", "told", "seen_ms")
_NONE = -(1 << 62)  # no comment, no analysis


class QueueState(StatefulProcessor):
    """Totals, last comments and last analyses of the articles of a bucket, each kept for ``ttl`` seconds after its
    last event. Timers wake the articles that become stale while nothing happens. A bucket is read and written
    once a batch, and all of its articles are worked on at a time."""

    def __init__(self, threshold: int, gap: int, ttl: int):
        self.threshold, self.gap, self.ttl = threshold, gap, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("articles", _STATE, self.ttl * 1000)

    def _load(self, now_ms: int) -> pd.DataFrame:
        values = self.state.get() if self.state.exists() else ([],) * len(_COLUMNS)
        held = pd.DataFrame({c: np.array(v, np.int64) for c, v in zip(_COLUMNS, values)}).set_index("article_id")
        return held[held.seen_ms + self.ttl * 1000 > now_ms]

    def _save(self, held: pd.DataFrame) -> None:
        if len(held):
            self.state.update((held.index.tolist(), *(held[c].tolist() for c in _COLUMNS[1:])))
        else:
            self.state.clear()

    def _wake(self, held: pd.DataFrame, now_ms: int) -> None:
        """A timer for the next article that will be stale; each wake asks for the one after it."""
        due = (held.analysed_at[_waiting(held)] + self.gap) * 1000 + 1
        if len(due := due[due > now_ms]):
            self.handle.registerTimer(int(due.min()))

    def handleInputRows(self, key, rows, timerValues):
        now_ms = timerValues.getCurrentProcessingTimeInMs()
        held = self._load(now_ms)
        frame = pd.concat([f[["article_id", "at", "weight"]] for f in rows], ignore_index=True)
        comment = frame.weight.notna()
        fresh = pd.DataFrame({
            "article_id": frame.article_id.astype("int64"), "net": frame.weight.fillna(0).astype("int64"), "number": 1,
            "pushed_at": frame["at"].where(comment, _NONE).astype("int64"), "analysed_at": frame["at"].where(~comment, _NONE).astype("int64"),
        }).groupby("article_id").agg({"net": "sum", "number": "sum", "pushed_at": "max", "analysed_at": "max"})
        old = held.reindex(fresh.index)
        old = old.fillna({"net": 0, "number": 0, "pushed_at": _NONE, "analysed_at": _NONE, "told": 0, "seen_ms": 0}).astype("int64")
        new = pd.DataFrame({
            "net": old.net + fresh.net, "number": old.number + fresh.number, "pushed_at": np.maximum(old.pushed_at, fresh.pushed_at),
            "analysed_at": np.maximum(old.analysed_at, fresh.analysed_at), "told": old.told.where(fresh.analysed_at <= old.analysed_at, 0), "seen_ms": now_ms,
        })
        wanted = new.net >= self.threshold
        moved = wanted != (old.net >= self.threshold)
        stale = _waiting(new) & ((new.analysed_at + self.gap) * 1000 < now_ms)
        new.loc[stale, "told"] = 1
        held = pd.concat([held[~held.index.isin(new.index)], new]).sort_index()
        self._save(held)
        self._wake(held, now_ms)
        yield pd.concat([_changes(new[moved & wanted], "entered"), _changes(new[moved & ~wanted], "left"), _changes(new[stale], "stale")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now_ms = timerValues.getCurrentProcessingTimeInMs()
        held = self._load(now_ms)
        stale = _waiting(held) & ((held.analysed_at + self.gap) * 1000 < now_ms)
        if stale.any():
            held.loc[stale, "number"] += 1
            held.loc[stale, "told"] = 1
            self._save(held)
        self._wake(held, now_ms)
        yield _changes(held[stale], "stale")

    def close(self) -> None:
        pass


def _waiting(held: pd.DataFrame) -> pd.Series:
    """Articles with a comment after their last analysis that nobody has been told of."""
    return (held.analysed_at != _NONE) & (held.pushed_at > held.analysed_at) & (held.told == 0)


def _changes(held: pd.DataFrame, event: str) -> pd.DataFrame:
    return pd.DataFrame({"article_id": held.index.to_numpy("int64"), "net": held.net.to_numpy("int64"), "event": pd.Series([event] * len(held), dtype=object), "number": held.number.to_numpy("int64")})


def queue_changes(events: DataFrame, threshold: int = THRESHOLD, gap: int = GAP, ttl: int = TTL, width: int = WIDTH) -> DataFrame:
    """Stream of (article_id long, at long, weight long) -> CHANGES: 'entered', 'left' and 'stale' articles.

    ``number`` counts an article's events, so that its last change can be told. Late comments count like others.
    An article without an event for ``ttl`` seconds is forgotten, as it is too old to be analysed again. The state of
    ``width`` ids in a row is kept together, as new articles, which are talked about, have neighbouring ids. Keeps
    its state in RocksDB, which the session is set to. Timers ask for batches without data for ever, so a query that
    is to end by itself (availableNow) is started within ``ending_queries``.
    """
    events.sparkSession.conf.set(PROVIDER, ROCKS)
    return (
        events.select("article_id", "at", "weight")
        .where("article_id is not null")
        .withColumn("bucket", F.expr(f"article_id div {width}"))
        .groupBy("bucket")
        .transformWithStateInPandas(QueueState(threshold, gap, ttl), outputStructType=CHANGES, outputMode="Update", timeMode="ProcessingTime")
    )


@contextmanager
def ending_queries(spark: SparkSession):
    """Queries started inside run no batches without data; their timers go off with the next data."""
    before = spark.conf.get(NO_DATA)
    spark.conf.set(NO_DATA, "false")
    try:
        yield
    finally:
        spark.conf.set(NO_DATA, before)


def queue_status(events: DataFrame, now: int, threshold: int = THRESHOLD, gap: int = GAP) -> DataFrame:
    """(article_id, net, wanted, stale) of the articles of all events."""
    comment = F.col("weight").isNotNull()
    sums = events.groupBy("article_id").agg(
        F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("net"), F.max(F.when(comment, F.col("at"))).alias("pushed_at"), F.max(F.when(~comment, F.col("at"))).alias("analysed_at")
    )
    stale = (F.col("pushed_at") > F.col("analysed_at")) & (F.col("analysed_at") + gap < now)
    return sums.select("article_id", "net", (F.col("net") >= threshold).alias("wanted"), F.coalesce(stale, F.lit(False)).alias("stale"))


def wanted_articles(changes: DataFrame) -> DataFrame:
    """(article_id, net) of the articles that the changes so far leave wanted; net as of when they entered."""
    last = changes.where("event in ('entered', 'left')").groupBy("article_id").agg(F.max_by(F.struct("event", "net"), "number").alias("c"))
    return last.where("c.event = 'entered'").select("article_id", "c.net")
