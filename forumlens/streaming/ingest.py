"""Structured Streaming over landed pages and over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import ingest, state


def apply_article_pages(store: state.Store, pages: DataFrame, now: int) -> None:
    """Upserts one batch of landed article pages and replaces their pushes, in one commit.

    Pages that aren't articles and failed fetches are left out; of several pages of one article the last
    fetched counts, however its address is spelled. What only the index shows (nrec_raw, mark) stays.
    Applying a batch twice changes nothing more.
    """
    parts = X.article_url_parts(F.col("url"))
    named = pages.where("status = 200").withColumns({"name": parts["board"], "_key": parts["url_id"]}).where("name is not null")

    def apply(change: state.Change) -> None:
        boards = change.read("boards").select("name", F.col("id").alias("board_id"))
        rows = named.join(boards, "name").withColumn("nrec_raw", F.lit(None).cast("string")).withColumn("mark", F.lit(None).cast("string"))
        parsed, _ = ingest.articles_of(state.last_of_key(rows, ["board_id", "_key"], "fetched_at"))
        parsed = change.scratch(parsed.drop("nrec_raw", "mark"))  # pages are parsed once
        fields = parsed.drop("pushes")
        articles = change.update("articles", fields, lambda old: state.upsert_articles(old, fields, now, change.top("articles")))
        ids = articles.select("board_id", "url_id", F.col("id").alias("article_id"))
        fresh = change.scratch(parsed.select("board_id", "url_id", "pushes").join(ids, ["board_id", "url_id"]))
        change.update("pushes", fresh, lambda old: state.replace_pushes(old, ingest.pushes_of(fresh), fresh))

    store.retry(apply)


def ingest_pages(pages: DataFrame, store: state.Store, checkpoint: str, clock: Callable[[], int]):
    """Starts a query that applies all landed pages and stops."""
    return (
        pages.writeStream.foreachBatch(lambda batch, _: apply_article_pages(store, batch, clock()))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events and their users by day and type, for a stream or a table: tumbling windows over ``ts``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    by_day = rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return by_day.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "value")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each event once within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
