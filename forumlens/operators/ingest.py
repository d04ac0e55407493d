"""Ingest steps as joins of parsed pages against the stored tables.

Every function is pure: it takes tables and parsed pages and returns rows that say what to do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..sources.folders import exists, shared_folder
from . import state as S

VANISH_GUARD = 100
MIN_INTERVAL, MAX_INTERVAL = 120, 604800


def index_entries(pages: DataFrame) -> DataFrame:
    """(board_id, page, body) -> a row for each entry, in the order of the page."""
    H.bounded_batches(pages.sparkSession)
    parsed = pages.select("board_id", "page", H.parse_index(F.col("body")).alias("p"))
    rows = parsed.select("board_id", "page", "p.max_page", F.posexplode("p.entries").alias("pos", "e"))
    return rows.select("board_id", "page", "max_page", "pos", "e.*", X.url_id_time(F.col("e.url_id")).alias("url_timestamp"))


def articles_of(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(board_id, url, body, nrec_raw, mark) -> (article rows, failures with their error)."""
    H.bounded_batches(pages.sparkSession)
    parsed = pages.withColumn("p", H.parse_article(F.col("body"), F.col("url")))
    good = parsed.where("p.error is null").select(
        "board_id", F.col("p.url_id").alias("url_id"), F.coalesce(X.url_id_time(F.col("p.url_id")), F.lit(0)).alias("url_timestamp"),
        X.posted_at(F.col("p.posted_text")).alias("posted_at"),
        *(X.empty_to_null(F.col(f"p.{c}")).alias(c) for c in ("title", "author", "content", "ip")),
        X.empty_to_null(F.col("mark")).alias("mark"), X.empty_to_null(F.col("nrec_raw")).alias("nrec_raw"),
        *(F.col(f"p.{c}").cast("long").alias(c) for c in ("push_count", "boo_count", "neutral_count")),
        (F.col("p.push_count") - F.col("p.boo_count")).cast("long").alias("net_count"), F.col("p.pushes").alias("pushes"),
    )
    return good, parsed.where("p.error is not null").select("board_id", "url", F.col("p.error").alias("error"))


def pushes_of(articles: DataFrame) -> DataFrame:
    """Article rows with (article_id, pushes) -> push rows; seq is the place from 0."""
    rows = articles.select("article_id", F.posexplode("pushes").alias("seq", "p"))
    return rows.select(
        "article_id", F.col("seq").cast("long").alias("seq"), F.col("p.tag").alias("tag"), X.empty_to_null(F.col("p.user_id")).alias("user_id"),
        X.empty_to_null(F.col("p.content")).alias("content"), X.empty_to_null(F.col("p.ip_datetime")).alias("ipdatetime"),
    )


def _listed(entries: DataFrame) -> DataFrame:
    return entries.where("not deleted and url_id <> ''")


def oldest_time(entries: DataFrame) -> DataFrame:
    """The oldest listed time by board, pinned entries apart; 0 if there's none."""
    own = F.when(~F.col("deleted") & (F.col("mark") != "!"), F.col("url_timestamp"))
    return entries.groupBy("board_id").agg(F.coalesce(F.min(own), F.lit(0)).alias("oldest"))


def newest_time(entries: DataFrame) -> DataFrame:
    """The newest listed time by board; pinned entries are old and can't matter."""
    own = F.when(~F.col("deleted") & (F.col("url_id") != ""), F.col("url_timestamp"))
    return entries.groupBy("board_id").agg(F.coalesce(F.max(own), F.lit(0)).alias("newest"))


def nrec_changed(stored: Column, listed: Column) -> Column:
    return F.coalesce(stored, F.lit("")) != F.coalesce(listed, F.lit(""))


def meta_changed(stored_nrec: Column, stored_mark: Column, nrec: Column, mark: Column) -> Column:
    return nrec_changed(stored_nrec, nrec) | ~stored_mark.eqNullSafe(X.empty_to_null(mark))


def entry_actions(entries: DataFrame, articles: DataFrame) -> DataFrame:
    """What each listed entry asks for: insert, and resurrect, refetch and update_meta of known ones."""
    known = articles.select(
        "board_id", "url_id", F.col("id").alias("article_id"), F.col("nrec_raw").alias("old_nrec"), F.col("mark").alias("old_mark"), "deleted_at"
    )
    rows = _listed(entries).join(known, ["board_id", "url_id"], "left")
    new = F.col("article_id").isNull()
    return rows.select(
        "board_id", "url_id", "article_id", "nrec_raw", "mark", new.alias("insert"),
        (~new & F.col("deleted_at").isNotNull()).alias("resurrect"),
        (~new & nrec_changed(F.col("old_nrec"), F.col("nrec_raw"))).alias("refetch"),
        (~new & meta_changed(F.col("old_nrec"), F.col("old_mark"), F.col("nrec_raw"), F.col("mark"))).alias("update_meta"),
    )


def next_intervals(boards: DataFrame, actions: DataFrame, now: int, low: int = MIN_INTERVAL, high: int = MAX_INTERVAL) -> DataFrame:
    """(board_id, check_interval_secs, next_check_at) of the boards checked."""
    new = actions.groupBy("board_id").agg(F.bool_or("insert").alias("new"))
    rows = boards.select(F.col("id").alias("board_id"), "check_interval_secs").join(new, "board_id")
    out = rows.select("board_id", X.next_interval(F.col("check_interval_secs"), F.col("new"), low, high).alias("check_interval_secs"))
    return out.withColumn("next_check_at", F.lit(now) + F.col("check_interval_secs"))


def vanished_candidates(articles: DataFrame, entries: DataFrame) -> DataFrame:
    """Live articles newer than the page's oldest entry that the page doesn't list."""
    listed = _listed(entries)
    oldest = listed.groupBy("board_id").agg(F.min("url_timestamp").alias("oldest")).where("oldest is not null")
    rows = articles.where("deleted_at is null").join(oldest, "board_id").where("url_timestamp > oldest")
    return rows.join(listed.select("board_id", "url_id"), ["board_id", "url_id"], "left_anti").select("board_id", "url_id", "url_timestamp")


def vanished(articles: DataFrame, first: DataFrame, again: DataFrame, previous: DataFrame, statuses: DataFrame, guard: int = VANISH_GUARD) -> DataFrame:
    """Articles (board_id, url_id) that are gone for certain; when unsure, none.

    1. missing from the newest page when it's fetched once, and again;
    2. not newer than the newest entry of the page, which else would be stale;
    3. newer than the newest entry of the page before (so they must be on the newest), and not on that
       page; a board whose only page is the newest has no page before, and a page before that
       couldn't be fetched judges nothing;
    4. not more than ``guard`` of a board;
    5. their own address is known to be gone: ``statuses`` has 404 for (board_id, url_id).

    ``previous`` has the entries of the page before, or a row with page 0 and no url_id for a board that
    has none.
    """
    both = vanished_candidates(articles, again).join(
        vanished_candidates(articles, first).select("board_id").distinct(), "board_id", "left_semi"
    )
    rows = both.join(newest_time(again), "board_id").where("newest > 0 and url_timestamp <= newest")
    before = previous.groupBy("board_id").agg(
        F.max("page").alias("prev_page"), F.max(F.when(~F.col("deleted") & (F.col("url_id") != ""), F.col("url_timestamp"))).alias("prev_newest")
    )
    rows = rows.join(before, "board_id")
    rows = rows.where("prev_page < 1 or (prev_newest is not null and url_timestamp > prev_newest)")
    rows = rows.join(_listed(previous).select("board_id", "url_id"), ["board_id", "url_id"], "left_anti")
    few = rows.groupBy("board_id").agg(F.count("*").alias("n")).where(F.col("n") <= guard)
    rows = rows.join(few, "board_id", "left_semi")
    gone = statuses.where("status = 404").select("board_id", "url_id")
    return rows.join(gone, ["board_id", "url_id"], "left_semi").select("board_id", "url_id")


def audit_results(due: DataFrame, statuses: DataFrame, now: int) -> DataFrame:
    """(board_id, url_id, checked_at, result) of deletions looked up again; other failures leave no row."""
    rows = due.select("board_id", "url_id").join(statuses, ["board_id", "url_id"])
    result = F.when(F.col("status") == 200, "alive").when(F.col("status") == 404, "gone")
    return rows.select("board_id", "url_id", F.lit(now).cast("long").alias("checked_at"), result.alias("result")).where("result is not null")


def backfill_pages(last_page: int, latest: int, batch: int) -> tuple[int, int]:
    """(first, last) page of the next batch, newest to oldest; 0 for ``batch`` goes to page 1."""
    start = last_page - 1
    if not 1 <= start <= latest:
        start = latest
    return start, max(1, start - batch + 1) if batch > 0 else 1


def backfill_step(entries: DataFrame, window_bottom: int, first: int, last: int) -> DataFrame:
    """For each board of a batch of pages: where it stopped and its state after it.

    Pages are taken from ``first`` down to ``last``; the first page whose oldest entry is older than
    the window ends the batch there.
    """
    own = F.when(~F.col("deleted") & (F.col("mark") != "!"), F.col("url_timestamp"))
    pages = entries.groupBy("board_id", "page").agg(F.coalesce(F.min(own), F.lit(0)).alias("oldest"))
    past = F.lit(window_bottom > 0) & (F.col("oldest") > 0) & (F.col("oldest") < window_bottom)
    stop = pages.groupBy("board_id").agg(F.max(F.when(past, F.col("page"))).alias("stop"))
    taken = pages.join(stop, "board_id").where(F.col("page") >= F.coalesce("stop", F.lit(last)))
    out = taken.groupBy("board_id").agg(
        F.min("page").alias("last_backfill_page"), F.min_by(F.nullif("oldest", F.lit(0)), "page").alias("window_floor"), F.first("stop").alias("stop")
    )
    done = F.col("stop").isNull() & F.lit(last <= 1)
    return out.select(
        "board_id", "last_backfill_page", F.when(done, F.lit(0)).otherwise(F.col("window_floor")).cast("long").alias("window_floor"),
        done.alias("complete"), F.col("stop").isNotNull().alias("at_boundary"),
    )


LEVEL = "href string, name string, title string, user_count long, is_board boolean, path string"


def discover(pages: Callable[[list[str]], DataFrame], start: str = "/cls/1", folder: str | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Boards below a category, level by level, each page once: (name, title, user_count, category_path).

    ``pages`` gives (url, body) for paths. Each level is written below ``folder`` (a new one unless given) once it has
    been read, so a walk that is started again on its folder asks for no page of a level that is complete. The
    frontier of a level is the driver's work list, a path for each category; a category already seen is not entered
    again, so the walk ends whatever its depth. A board of several categories has the first path in order.

    With ``hot``, the page (body) of the hot list, there is is_hot as well: listed boards have the list's title and user
    count, and those of no category come too.
    """
    spark = SparkSession.active()
    folder = folder or shared_folder(spark, "discovery")
    seen, level, number = {start}, {start: ""}, 0
    while level:
        place = f"{folder}/level-{number}"
        if not exists(spark, f"{place}/_SUCCESS"):
            above = spark.createDataFrame(list(level.items()), "url string, parent string")
            rows = pages(list(level)).join(F.broadcast(above), "url").select("parent", F.explode(H.parse_category(F.col("body"))).alias("e"))
            path = F.when(F.col("parent") == "", F.col("e.name")).otherwise(F.concat("parent", F.lit(" > "), "e.name"))
            users = F.when(F.col("e.user_count") > 0, F.col("e.user_count").cast("long"))
            rows.select(
                "e.href", "e.name", X.empty_to_null(F.col("e.title")).alias("title"), users.alias("user_count"), "e.is_board", path.alias("path")
            ).write.mode("overwrite").parquet(place)
        below = spark.read.schema(LEVEL).parquet(place).where("not is_board").groupBy("href").agg(F.min("path").alias("path"))
        level = {r.href: r.path for r in below.collect() if r.href not in seen}
        seen |= set(level)
        number += 1
    found = spark.read.schema(LEVEL).parquet(*(f"{folder}/level-{k}" for k in range(number))).where("is_board")
    first = F.min(F.struct(F.coalesce("path", F.lit("")).alias("p"), "title", "user_count")).alias("f")
    boards = found.groupBy("name").agg(first).select("name", "f.title", "f.user_count", X.empty_to_null(F.col("f.p")).alias("category_path"))
    return boards if hot is None else with_hot_flags(boards, hot)


def hot_listed(pages: DataFrame) -> DataFrame:
    """The boards of hot list pages (body): (name, title, user_count), each name once; a page without boards fails."""
    boards = F.coalesce(H.parse_hot_boards(F.col("body")), F.raise_error(F.lit("no boards on the page of the hot list")))
    rows = pages.select(F.explode(boards).alias("e")).select("e.name", "e.title", F.col("e.n_user").cast("long").alias("user_count"))
    return S.last_of_key(rows, ["name"])


def with_hot_flags(boards: DataFrame, hot: DataFrame) -> DataFrame:
    listed = hot_listed(hot).select("name", X.empty_to_null(F.col("title")).alias("_title"), F.when(F.col("user_count") > 0, F.col("user_count")).alias("_users"), F.lit(True).alias("_hot"))
    rows = boards.join(listed, "name", "full")
    return rows.select(
        "name", F.when(F.col("_hot"), F.col("_title")).otherwise(F.col("title")).alias("title"), F.when(F.col("_hot"), F.col("_users")).otherwise(F.col("user_count")).alias("user_count"),
        "category_path", F.coalesce("_hot", F.lit(False)).alias("is_hot"),
    )


def discover_into(store: S.Store, pages: Callable[[list[str]], DataFrame], hot: DataFrame, now: int, folder: str | None = None) -> int:
    """The whole discovery, stored: all boards of the walk and of the hot list, hot ones marked, none unmarked.
    Returns how many boards it saw; running it again changes what the pages have changed."""
    with store.scratch() as keep:
        found = keep(discover(pages, folder=folder, hot=hot))

        def apply(change: S.Change) -> None:
            def made(old: DataFrame) -> DataFrame:
                out = S.upsert_boards(old, found, now, change.top("boards"))
                hit = found.where("is_hot").select("name", F.lit(True).alias("_hit"))
                return out.join(hit, "name", "left").withColumn("is_hot", F.coalesce("is_hot", F.lit(False)) | F.coalesce("_hit", F.lit(False))).drop("_hit")

            change.update("boards", found, made)

        store.retry(apply)
        return found.count()


def apply_hot_list(boards: DataFrame, pages: DataFrame, now: int) -> DataFrame:
    """Boards after a page (body) of the hot list: its boards are upserted and marked hot, none is unmarked."""
    listed = hot_listed(pages)
    known = boards.select("name", "category_path")  # the list shows no category
    out = S.upsert_boards(boards, listed.join(known, "name", "left"), now)
    hit = listed.select("name").distinct().withColumn("_hit", F.lit(True))
    return out.join(hit, "name", "left").withColumn("is_hot", F.col("is_hot") | F.coalesce("_hit", F.lit(False))).select(boards.columns)
