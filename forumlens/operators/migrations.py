"""Ordered steps from an empty or old store to the present tables, each applied once.

A store's pointer names the steps that it has had. A step and its name are one change, so it is there as a
whole or not at all, and of two drivers that migrate one store each step is applied by one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from . import state as S
from .store import Change, Store

BACKFILL_SECONDS = 90 * 86400


class NewerStore(RuntimeError):
    """The store has had steps that this code doesn't know."""


def _forum_tables(change: Change, now: int) -> None:
    for name in ("boards", "articles", "pushes", "crawl_runs", "backfill_meta"):
        change.create(name)
    meta = change.read("backfill_meta")
    if meta.where("key = 'window_bottom'").isEmpty():
        first = meta.sparkSession.createDataFrame([("window_bottom", now - BACKFILL_SECONDS)], meta.schema)
        change.update("backfill_meta", first, lambda old: old.unionByName(first))


def _insights(change: Change, now: int) -> None:
    change.create("article_insights")


def _audits(change: Change, now: int) -> None:
    change.create("deletion_audits")


def _insight_versions(change: Change, now: int) -> None:
    """Insights from before the versions are of the first one."""
    rows = change.read("article_insights").where("schema_ver is null").select("article_id")
    change.update("article_insights", rows, lambda old: old.withColumn("schema_ver", F.coalesce("schema_ver", F.lit(1).cast("long"))))


def _entities(change: Change, now: int) -> None:
    """Entity rows of the insights that there are."""
    change.create("entity_refs")
    change.create("entity_aliases")
    insights = change.read("article_insights").where("entities is not null")
    known = change.read("entity_refs").select("article_id").distinct()
    missing = change.scratch(insights.join(known, "article_id", "left_anti"))
    change.update("entity_refs", missing, lambda old: old.unionByName(S.entity_refs_of(missing)))


def _digests(change: Change, now: int) -> None:
    change.create("board_digests")


def _articles_by_author(change: Change, now: int) -> None:
    """Rewrites the articles in the layout for look-ups by author."""
    change.replace("articles", change.read("articles"))


def _pushes_by_user(change: Change, now: int) -> None:
    change.replace("pushes", change.read("pushes"))


STEPS: tuple[tuple[str, Callable[[Change, int], None]], ...] = (
    ("1 forum tables", _forum_tables),
    ("2 insights", _insights),
    ("3 deletion audits", _audits),
    ("4 insight versions", _insight_versions),
    ("5 entities", _entities),
    ("6 board digests", _digests),
    ("7 articles by author", _articles_by_author),
    ("8 pushes by user", _pushes_by_user),
)


def schema_version(store: Store) -> int:
    """How many steps a store has had."""
    return len(store._current()[1].get("steps", []))


def migrate(store: Store, now: int, steps: tuple = STEPS) -> list[str]:
    """Applies the steps that the store hasn't had, in order, and returns those that this call applied."""
    names, applied = [n for n, _ in steps], []
    for name, step in steps:

        def apply(change: Change) -> bool:
            had = change.steps
            if had != names[: len(had)]:
                raise NewerStore(f"the store has had {had[-1]!r}")
            if name in had:
                return False
            step(change, now)
            had.append(name)
            return True

        if store.retry(apply, attempts=2 * len(names)):
            applied.append(name)
    return applied
