"""Batches of the insight worker: a queue, its answers, and what they change, in one commit each.

Answers are written before the change is made, so a change that is run again after a conflict asks nothing twice, and a
batch that is run again finds its articles out of the queue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import enrich as E
from . import reads as R
from . import state as S

DAY = 86400


def _with_pushes(t: R.Tables, rows: DataFrame) -> DataFrame:
    own = t["pushes"].join(F.broadcast(rows.select(F.col("id").alias("article_id"))), "article_id", "left_semi")  # the queue's limit bounds it
    return rows.join(R.first_pushes(own), F.col("id") == F.col("article_id"), "left").drop("article_id")


def _analyse(store: S.Store, queue: DataFrame, completer: E.Completer, model: str, now: int, concurrency: int, error_prefix: str = "") -> tuple[int, int]:
    """(analysed, failed) articles of a queue, stored."""
    with store.scratch() as keep:
        written = keep(E.analyze(E.with_prompts(queue), completer, model, concurrency=concurrency))
        good, bad = E.answers_and_errors(written)
        bad = bad.withColumn("error", F.concat(F.lit(error_prefix), "error")) if error_prefix else bad
        total, failed = written.count(), bad.count()
        if not total:
            return 0, 0

        def apply(change: S.Change) -> None:
            touched = written.select("article_id")
            new = change.update("article_insights", touched, lambda old: S.mark_insight_errors(S.store_insights(old, good, now), bad, now))
            changed = change.scratch(new.join(good.select("article_id"), "article_id", "left_semi"))
            change.update("entity_refs", good.select("article_id"), lambda old: S.sync_entity_refs(old, changed))

        store.retry(apply)
    return total - failed, failed


def analyse_batch(
    store: S.Store, completer: E.Completer, model: str, now: int, limit: int = 10, min_net: int = 20, min_age: int = 0, refresh_days: int = 7, concurrency: int = 3
) -> int:
    """New articles first, then those with news since their analysis. Returns how many were analysed; a queue with
    failures counts as none, so that the caller pauses."""
    done = 0
    for stale in (False, True):
        if stale and refresh_days <= 0:
            break
        t = store.tables()
        rows = R.stale_articles(t, now, now - refresh_days * DAY, limit, min_net) if stale else R.pending_articles(t, now, limit, min_net, min_age)
        analysed, failed = _analyse(store, _with_pushes(t, rows), completer, model, now, concurrency)
        done += 0 if failed else analysed
    return done


def analyse_filtered(store: S.Store, fallback: E.Completer, model: str, now: int, limit: int = 10, min_age: int = 0) -> int:
    """Articles that the first model declined, one after the other by another model."""
    t = store.tables()
    rows = R.filtered_articles(t, now, limit, min_age)
    return _analyse(store, _with_pushes(t, rows), fallback, model, now, 1, "fallback: ")[0]


def daily_digests(store: S.Store, completer: E.Completer, model: str, now: int, concurrency: int = 3) -> int:
    """Digests of today (UTC+8) for the hot boards that have none and have three fresh insights or more.

    A call that fails or a blank answer leaves no digest, so the next run tries that board again; a digest that another
    run stored meanwhile stays. Returns how many were stored.
    """
    with store.scratch() as keep:
        t = store.tables()
        day = t["boards"].sparkSession.range(1).select(X.local_day(F.lit(now)).alias("d")).first().d
        open_ = R.boards_without_digest(t, day).select(F.col("id").alias("board_id"))
        prompts = R.digest_prompts(t, now - DAY).join(open_, "board_id", "left_semi")
        made = keep(E.digests(prompts, day, now, completer, model, concurrency))
        if made.isEmpty():
            return 0

        def apply(change: S.Change) -> int:
            had = change.read("board_digests").where(F.col("day") == day).select("board_id")
            fresh = change.scratch(made.join(had, "board_id", "left_anti"))
            change.update("board_digests", fresh, lambda old: S.store_digests(old, fresh))
            return fresh.count()

        return store.retry(apply)
