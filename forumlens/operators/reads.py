"""Read queries: pure functions of the tables, an explicit ``now`` and parameters.

Every limit has a total order before it, with the key as the last tiebreak.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import analysis as A
from ..functions import text as X

Tables = dict[str, DataFrame]
DAY = 86400


def live(t: Tables) -> DataFrame:
    return t["articles"].where("deleted_at is null")


def clean(t: Tables) -> DataFrame:
    """Insights without an error."""
    return t["article_insights"].where("error is null")


def _boards(t: Tables, *columns: str) -> DataFrame:
    return t["boards"].select(F.col("id").alias("board_id"), F.col("name").alias("board"), *columns)


# boards


def boards_count(t: Tables, min_articles: int = 1) -> DataFrame:
    counts = live(t).groupBy("board_id").agg(F.count("*").alias("articles")).where(F.col("articles") >= min_articles)
    boards = t["boards"].select(F.col("id").alias("board_id"), "name", "user_count")
    return counts.join(boards, "board_id").orderBy(F.desc("articles"), F.desc("user_count"), "board_id")


def board_by_name(t: Tables, name: str) -> DataFrame:
    board = t["boards"].where(F.col("name") == name).select(F.col("id").alias("board_id"), "name", "title", "user_count")
    counts = live(t).groupBy("board_id").agg(F.count("*").alias("articles"))
    return board.join(counts, "board_id", "left").withColumn("articles", F.coalesce("articles", F.lit(0)))


def hot_boards(t: Tables) -> DataFrame:
    return t["boards"].where("is_hot").select("id", "name").orderBy("name")


# articles


def cards(t: Tables) -> DataFrame:
    """Live articles with their board and, if there is one, their insight (with or without an error)."""
    own = t["article_insights"].select(
        F.col("article_id").alias("id"), "tldr", "community_take", "sentiment", "controversy", X.parse_tags(F.col("tags")).alias("tags"), F.lit(True).alias("has_insight")
    )
    out = live(t).join(_boards(t), "board_id").join(own, "id", "left")
    return out.select(
        "id", "board_id", "board", "url_id", X.title_or_default(F.col("title")).alias("title"), "author", "posted_at", "mark",
        "push_count", "boo_count", "net_count", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("content_length"),
        F.coalesce("has_insight", F.lit(False)).alias("has_insight"), "tldr", "community_take", "sentiment", "controversy",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def board_page(t: Tables, board_id: int, page: int = 1, size: int = 30) -> DataFrame:
    """A page of a board's newest articles, pinned ones last on the page; ``place`` is the row's order."""
    own = cards(t).where(F.col("board_id") == board_id)
    top = own.orderBy(F.desc("posted_at"), F.desc("id")).offset((page - 1) * size).limit(size)
    pinned = F.col("title").startswith(X.PINNED)
    order = Window.orderBy(pinned, F.desc("posted_at"), F.desc("id"))  # a page at most
    return top.withColumn("pinned", pinned).withColumn("place", F.row_number().over(order).cast("long"))


def ordered_pushes(pushes: DataFrame, *more: str) -> DataFrame:
    rows = F.struct("seq", "tag", "user_id", "content", *more)
    return pushes.groupBy("article_id").agg(F.array_sort(F.collect_list(rows)).alias("pushes"))


def first_pushes(pushes: DataFrame, limit: int = A.MAX_PUSHES) -> DataFrame:
    """(article_id, pushes, n_pushes): the first pushes of each article in order, and how many it has; no more than
    ``limit`` are gathered into a row."""
    by_place = Window.partitionBy("article_id").orderBy("seq")
    first = pushes.withColumn("_n", F.row_number().over(by_place)).where(F.col("_n") <= limit)
    counts = pushes.groupBy("article_id").agg(F.count("*").alias("n_pushes"))
    return ordered_pushes(first).join(counts, "article_id")


_INSIGHT = ("key_points", "top_comments", "model", "article_type", "ad_likelihood", "factuality", "ai_generated", "push_facts", "qa_summary")


def _detail(t: Tables, own: DataFrame, narrow: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Cards with text, address, the whole insight and all pushes in order; ``narrow`` keeps the rows of the
    articles, given their id column."""
    body = narrow(t["articles"], "id").select("id", "content", "ip")
    insight = narrow(t["article_insights"], "article_id").select(
        F.col("article_id").alias("id"), F.col("generated_at").alias("insight_generated_at"), *_INSIGHT,
        X.parse_entities(F.col("entities")).alias("entities"), X.parse_stance(F.col("push_stance")).alias("push_stance"),
    )
    pushes = ordered_pushes(narrow(t["pushes"], "article_id"), "ipdatetime").withColumnRenamed("article_id", "id")
    out = own.join(body, "id").join(insight, "id", "left").join(pushes, "id", "left")
    none = F.array().cast("array<struct<seq:bigint,tag:string,user_id:string,content:string,ipdatetime:string>>")
    named = F.array().cast("array<struct<name:string,type:string>>")
    return out.withColumns({"pushes": F.coalesce("pushes", none), "entities": F.coalesce("entities", named)})


def article_detail(t: Tables, article_ids: list[int]) -> DataFrame:
    """Whole articles by id, any number of them in one job; the ids reach the scans."""
    own = cards(t).where(F.col("id").isin(article_ids))
    return _detail(t, own, lambda df, key: df.where(F.col(key).isin(article_ids)))


def article_id(t: Tables, board: str, url_id: str) -> DataFrame:
    """The id of a live article's address; one row or none."""
    return live(t).where(F.col("url_id") == url_id).join(_boards(t).where(F.col("board") == board), "board_id").select("id")


def article_by_url(t: Tables, board: str, url_id: str) -> DataFrame:
    """The same for an article's address; (board, url_id) is a key, so its id can be broadcast."""
    own = cards(t).where((F.col("board") == board) & (F.col("url_id") == url_id))
    ids = article_id(t, board, url_id)
    return _detail(t, own, lambda df, key: df.join(F.broadcast(ids.withColumnRenamed("id", key)), key, "left_semi"))


# authors


def author_articles(t: Tables, author: str, limit: int = 50) -> DataFrame:
    own = live(t).where(F.col("author") == author).join(_boards(t, "is_hot").where("is_hot"), "board_id")
    insight = clean(t).select(F.col("article_id").alias("id"), "tldr", "sentiment")
    out = own.join(insight, "id", "left").select(
        "id", "board", "url_id", X.title_or_default(F.col("title")).alias("title"), "posted_at", "net_count", "tldr", "sentiment"
    )
    return out.orderBy(F.desc("posted_at"), F.desc("id")).limit(limit)


def author_stats(t: Tables, author: str) -> DataFrame:
    own = live(t).where(F.col("author") == author).join(_boards(t, "is_hot").where("is_hot"), "board_id")
    return own.agg(
        F.countDistinct("board_id").alias("boards"), F.count("*").alias("total"), F.coalesce(F.sum("net_count"), F.lit(0)).alias("net_sum")
    )


def _user_pushes(t: Tables, user: str) -> DataFrame:
    own = t["pushes"].where(F.col("user_id") == user)
    articles = live(t).select(F.col("id").alias("article_id"), "board_id", "url_id", "title", "posted_at")
    return own.join(articles, "article_id").join(_boards(t, "is_hot").where("is_hot"), "board_id")


def user_pushes(t: Tables, user: str, limit: int = 50) -> DataFrame:
    out = _user_pushes(t, user).select(
        "article_id", "seq", "tag", "content", "board", "url_id", X.title_or_default(F.col("title")).alias("title"), "posted_at"
    )
    return out.orderBy(F.desc("posted_at"), F.desc("article_id"), F.desc("seq")).limit(limit)


def push_stats(t: Tables, user: str) -> DataFrame:
    """Counts by tag; a user without pushes has zeros."""

    def tagged(tag: str) -> Column:
        return F.count_if(F.col("tag") == tag)

    return _user_pushes(t, user).agg(
        F.count("*").alias("total"), F.countDistinct("board_id").alias("boards"), tagged("推").alias("pushes"),
        tagged("噓").alias("boos"), tagged("→").alias("neutrals"),
    )


# deleted


def deleted_articles(t: Tables, limit: int = 100) -> DataFrame:
    gone = t["articles"].where("deleted_at > 0").join(_boards(t), "board_id")
    out = gone.join(clean(t).select(F.col("article_id").alias("id"), "tldr"), "id", "left").select(
        "id", "board", "url_id", X.title_or_default(F.col("title")).alias("title"), "author", "posted_at", "deleted_at",
        X.excerpt(F.coalesce("content", F.lit(""))).alias("excerpt"), "tldr",
    )
    return out.orderBy(F.desc("deleted_at"), F.desc("id")).limit(limit)


def deleted_by_day(t: Tables, limit: int = 100) -> DataFrame:
    """The same, a row for each UTC+8 day, newest first, with the articles in order."""
    rows = deleted_articles(t, limit).withColumn("day", X.local_day(F.col("deleted_at")))
    own = F.reverse(F.array_sort(F.collect_list(F.struct("deleted_at", "id"))))
    days = rows.groupBy("day").agg(F.count("*").alias("n"), own.alias("o"))
    return days.select("day", "n", F.col("o.id").alias("ids")).orderBy(F.desc("day"))


# entities


def expanded_names(t: Tables, query: str) -> DataFrame:
    """The canonical name of a query and all its aliases."""
    q = X.norm_query(query)
    one = t["entity_aliases"].where(F.col("alias") == q).agg(F.coalesce(F.max("canonical"), F.lit(q)).alias("name_norm"))
    more = t["entity_aliases"].join(one, F.col("canonical") == F.col("name_norm")).select(F.col("alias").alias("name_norm"))
    return one.unionByName(more).distinct()


def search_entities(t: Tables, query: str, limit: int = 30) -> DataFrame:
    q = X.like_literal(query)
    hits = t["entity_refs"].where(F.col("name_norm").contains(q) & F.lit(q != ""))
    out = hits.groupBy("name_norm", "name", "kind").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "name_norm", "name", "kind").limit(limit)


def _entity_rows(t: Tables, query: str, distinct: bool) -> DataFrame:
    refs = t["entity_refs"].join(F.broadcast(expanded_names(t, query)), "name_norm")  # an entity's aliases
    refs = refs.select("article_id").distinct() if distinct else refs.select("article_id")
    articles = live(t).withColumnRenamed("id", "article_id")
    own = clean(t).select("article_id", "sentiment", "tldr", "controversy")
    return refs.join(articles, "article_id").join(own, "article_id")


def entity_timeline(t: Tables, query: str, days: int = 60, distinct: bool = False) -> DataFrame:
    """Articles and mean sentiment for the newest ``days`` days that have any.

    An article that has two spellings of one entity counts twice unless ``distinct``.
    """
    rows = _entity_rows(t, query, distinct).where("posted_at is not null")
    by_day = rows.groupBy(X.local_day(F.col("posted_at")).alias("day")).agg(
        F.count("*").alias("articles"), (F.sum(X.sentiment_sign(F.col("sentiment"))) / F.count("*")).alias("sentiment")
    )
    return by_day.orderBy(F.desc("day")).limit(days)


def timeline_bars(timeline: DataFrame) -> DataFrame:
    """Oldest first, with the widths of each day's positive and negative bar in percent of the busiest day."""
    top = F.greatest(F.max("articles").over(Window.partitionBy()), F.lit(1))  # the days shown only
    whole = F.round(100.0 * F.col("articles") / top).cast("long")
    out = timeline.withColumn("total_pct", whole).withColumn("pos_pct", F.round(F.col("total_pct") * (1 + F.col("sentiment")) / 2).cast("long"))
    return out.withColumn("neg_pct", F.col("total_pct") - F.col("pos_pct")).orderBy("day")


def entity_articles(t: Tables, query: str, limit: int = 50, distinct: bool = False) -> DataFrame:
    rows = _entity_rows(t, query, distinct).join(_boards(t), "board_id")
    out = rows.select(
        "article_id", "board", "url_id", X.title_or_default(F.col("title")).alias("title"), "posted_at", "net_count", "tldr", "sentiment", "controversy"
    )
    return out.orderBy(F.desc("posted_at"), F.desc("article_id")).limit(limit)


def entity_count(t: Tables) -> DataFrame:
    return t["entity_refs"].agg(F.count("*").alias("refs"))


# trends


def trending(t: Tables, now: int, limit: int = 30) -> DataFrame:
    """Entities of at least 3 articles in 7 days; (name_norm, article) is a key, so counts are distinct."""
    recent = live(t).where(F.col("posted_at") > now - 7 * DAY).select(F.col("id").alias("article_id"), "posted_at")
    rows = t["entity_refs"].join(recent, "article_id").join(clean(t).select("article_id"), "article_id")
    out = rows.groupBy("name_norm").agg(
        F.max("name").alias("name"), F.max("kind").alias("kind"), F.count("*").alias("d7"), F.count_if(F.col("posted_at") > now - 2 * DAY).alias("h48")
    )
    out = out.where("d7 >= 3").orderBy(F.desc(F.col("h48") * 2 + F.col("d7")), F.desc("d7"), "name_norm").limit(limit)
    # widths of the bars of the view, against the largest of the rows shown
    score = F.col("h48") * 2 + F.col("d7")
    return out.withColumn("bar_pct", F.round(100.0 * F.col("d7") / F.max("d7").over(Window.partitionBy()))).withColumn("score", score)


def rising(t: Tables, now: int, max_age_hours: int = 12, limit: int = 30) -> DataFrame:
    """Fresh articles by pushes an hour; ordered with an age of half an hour at least, shown without."""
    age = F.lit(now) - F.col("posted_at")
    fresh = live(t).where((F.col("posted_at") > now - max_age_hours * 3600) & (F.col("push_count") > 5))
    pushes = F.col("push_count") * F.lit(3600.0)
    shown = F.when(age > 0, pushes / age).otherwise(F.col("push_count").cast("double"))
    out = fresh.withColumn("rank_vph", pushes / F.greatest(age, F.lit(1800))).withColumn("vph", shown)
    out = out.join(_boards(t), "board_id").orderBy(F.desc("rank_vph"), F.desc("id")).limit(limit)
    return out.select("id", "board", "url_id", "title", "posted_at", "push_count", "boo_count", "net_count", "vph")


def calibration(t: Tables, now: int, bucket_size: float = 10.0) -> DataFrame:
    """Share of hot ones (net >= 90, smoothed) of matured articles, by their lifetime pushes an hour."""
    matured = live(t).where(F.col("posted_at").between(now - 30 * DAY, now - 2 * DAY) & (F.col("push_count") > 5))
    vph = F.col("push_count") * F.lit(3600.0) / F.greatest(F.lit(now) - F.col("posted_at"), F.lit(3600))
    rows = matured.groupBy(F.floor(vph / F.lit(float(bucket_size))).alias("bucket")).agg(
        F.count("*").alias("n"), F.count_if(F.col("net_count") >= 90).alias("hot")
    )
    rows = rows.where("n >= 3")
    return rows.select(
        (F.col("bucket") * F.lit(float(bucket_size))).alias("bucket_vph"), "n", ((F.col("hot") + 1) / (F.col("n") + 2)).alias("p_hot")
    ).orderBy("bucket_vph")


def with_hot_probability(articles: DataFrame, buckets: DataFrame) -> DataFrame:
    """As-of lookup of ``vph``: the highest bucket at or below it, else the lowest bucket, else 0.

    The buckets are gathered into one sorted array, a row for each distinct velocity class, so there
    is no join of rows against rows.
    """
    table = buckets.agg(F.array_sort(F.collect_list(F.struct("bucket_vph", "p_hot"))).alias("b"))
    below = F.filter("b", lambda x: x["bucket_vph"] <= F.col("vph"))
    hit = F.coalesce(F.try_element_at(below, F.lit(-1)), F.try_element_at(F.col("b"), F.lit(1)))["p_hot"]
    return articles.join(F.broadcast(table)).withColumn("p_hot", F.coalesce(hit, F.lit(0.0))).drop("b")


def rising_with_probability(t: Tables, now: int, max_age_hours: int = 12, bucket_size: float = 10.0, limit: int = 30) -> DataFrame:
    return with_hot_probability(rising(t, now, max_age_hours, limit), calibration(t, now, bucket_size))


# digests


def digest_candidates(t: Tables, since: int, limit: int = 15, min_articles: int = 1) -> DataFrame:
    """The best articles analysed since then, at most ``limit`` a board, of boards with enough of them."""
    own = clean(t).where(F.col("generated_at") > since).select(F.col("article_id").alias("id"), "tldr", "sentiment")
    rows = live(t).join(own, "id").join(_boards(t), "board_id")
    by_net = Window.partitionBy("board_id").orderBy(F.col("net_count").desc_nulls_last(), F.desc("id"))
    top = rows.withColumn("place", F.row_number().over(by_net).cast("long")).where(F.col("place") <= limit)
    top = top.withColumn("candidates", F.count("*").over(Window.partitionBy("board_id"))).where(F.col("candidates") >= min_articles)
    return top.select("board_id", "board", "place", "id", X.title_or_default(F.col("title")).alias("title"), "net_count", "tldr", "sentiment")


def digest_prompts(t: Tables, since: int) -> DataFrame:
    """A prompt for each board with three candidates or more."""
    rows = digest_candidates(t, since, min_articles=3)
    line = F.concat(F.lit("- "), F.col("title"), F.lit("（"), F.col("net_count").cast("string"), F.lit("）："), F.coalesce("tldr", F.lit("")))
    parts = rows.groupBy("board_id", "board").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("rows"))
    return parts.select(
        "board_id", "board", F.size("rows").cast("long").alias("article_count"),
        F.concat(F.lit("看板："), F.col("board"), F.lit("\n"), F.array_join(F.col("rows.line"), "\n")).alias("prompt"),
    )


def latest_digests(t: Tables) -> DataFrame:
    """The newest digest of each hot board; boards without one stay, with nulls."""
    newest = t["board_digests"].groupBy("board_id").agg(F.max_by(F.struct("day", "digest", "article_count"), "day").alias("d"))
    out = t["boards"].where("is_hot").select(F.col("id").alias("board_id"), "name").join(newest, "board_id", "left")
    return out.select("board_id", "name", "d.day", "d.digest", "d.article_count").orderBy("name")


def boards_without_digest(t: Tables, day: str) -> DataFrame:
    had = t["board_digests"].where(F.col("day") == day).select(F.col("board_id").alias("id"))
    return t["boards"].where("is_hot").join(had, "id", "left_anti").select("id", "name").orderBy("name")


# queues


def _loaded(rows: DataFrame, *order: Column, limit: int) -> DataFrame:
    return rows.orderBy(*order, F.desc("id")).limit(limit).select("id", "board_id", "title", "author", "content", "net_count", "posted_at")


def _age_gate(now: int, min_age: int) -> Column:
    return F.lit(min_age == 0) | F.col("posted_at").isNull() | (F.col("posted_at") < now - min_age)


def _worth(min_net: int) -> Column:
    return (F.length("content") > 20) & (F.coalesce("net_count", F.lit(0)) >= min_net)


def insight_state(now: int, cooldown: int = 3600) -> Column:
    """What the queue does with an article: pending, cooling, filtered, outdated or done."""
    return (
        F.when(F.col("insight_id").isNull(), "pending")
        .when(F.col("error") == "content_filter", "filtered")
        .when(F.col("error").isNotNull(), F.when(F.col("generated_at") < now - cooldown, "pending").otherwise("cooling"))
        .when(F.col("schema_ver") < 2, "outdated")
        .otherwise("done")
    )


def _with_insight(t: Tables) -> DataFrame:
    own = t["article_insights"].select(F.col("article_id").alias("insight_id"), "error", "generated_at", "schema_ver")
    return t["articles"].join(own, F.col("id") == F.col("insight_id"), "left")


def pending_articles(t: Tables, now: int, limit: int = 50, min_net: int = 20, min_age: int = 0) -> DataFrame:
    rows = _with_insight(t).where("deleted_at is null").where(_worth(min_net) & _age_gate(now, min_age))
    rows = rows.where(insight_state(now).isin("pending", "outdated"))
    return _loaded(rows, F.col("net_count").desc_nulls_last(), F.col("posted_at").desc_nulls_last(), limit=limit)


def stale_articles(t: Tables, now: int, fresh_after: int, limit: int = 50, min_net: int = 20, gap: int = 3600) -> DataFrame:
    rows = _with_insight(t).where("deleted_at is null and insight_id is not null and error is null").where(_worth(min_net))
    rows = rows.where((F.col("posted_at") > fresh_after) & (F.col("last_fetched_at") > F.col("generated_at")) & (F.col("generated_at") < now - gap))
    return _loaded(rows, F.desc("posted_at"), limit=limit)


def filtered_articles(t: Tables, now: int, limit: int = 50, min_age: int = 0) -> DataFrame:
    rows = _with_insight(t).where("error = 'content_filter'").where(_age_gate(now, min_age))
    return _loaded(rows, F.col("net_count").desc_nulls_last(), limit=limit)


def insight_queue(t: Tables, now: int, fresh_after: int, limit: int = 50, min_net: int = 20, gap: int = 3600) -> DataFrame:
    """Pending articles, then stale ones (an article may be both), with their pushes in order.

    Articles meet their insights once; both limits are ranks within one window, of which Spark keeps the first
    rows before it shuffles.
    """
    rows = _with_insight(t).where("deleted_at is null").where(_worth(min_net))
    fresh = (F.col("posted_at") > fresh_after) & (F.col("last_fetched_at") > F.col("generated_at")) & (F.col("generated_at") < now - gap)
    stale = F.coalesce(F.col("insight_id").isNotNull() & F.col("error").isNull() & fresh, F.lit(False))
    pending = insight_state(now).isin("pending", "outdated")
    kinds = F.filter(F.array(F.when(pending, False), F.when(stale, True)), lambda k: k.isNotNull())
    rows = rows.withColumn("stale", F.explode(kinds))
    first = F.when(F.col("stale"), F.col("posted_at")).otherwise(F.col("net_count"))
    then = F.when(~F.col("stale"), F.col("posted_at"))
    by_kind = Window.partitionBy("stale").orderBy(first.desc_nulls_last(), then.desc_nulls_last(), F.desc("id"))
    rows = rows.withColumn("_n", F.row_number().over(by_kind)).where(F.col("_n") <= limit)
    rows = rows.select("id", "board_id", "title", "author", "content", "net_count", "posted_at", "stale")
    # two limits bound the queue, so it can be broadcast to keep only its own pushes
    own = t["pushes"].join(F.broadcast(rows.select(F.col("id").alias("article_id"))), "article_id", "left_semi")
    return rows.join(ordered_pushes(own), F.col("id") == F.col("article_id"), "left").drop("article_id")


def state_counts(t: Tables, now: int) -> DataFrame:
    rows = _with_insight(t).where("deleted_at is null")
    return rows.groupBy(insight_state(now).alias("state")).agg(F.count("*").alias("articles"))


def due_boards(t: Tables, now: int, limit: int = 1) -> DataFrame:
    rows = t["boards"].where(F.col("is_hot") & (F.col("next_check_at") <= now))
    return rows.orderBy("next_check_at", "id").limit(limit).select("id", "name", "next_check_at", "check_interval_secs")


def backfill_boards(t: Tables, now: int, window_bottom: int, limit: int = 1, claim_secs: int = 21600) -> DataFrame:
    free = F.col("backfill_claimed_at").isNull() | (F.col("backfill_claimed_at") < now - claim_secs)
    reach = F.col("window_floor").isNull() | (F.col("window_floor") > window_bottom)
    rows = t["boards"].where(~F.col("backfill_complete") & F.col("is_hot") & free & reach)
    return rows.orderBy(F.col("last_backfill_page") > 1, F.desc("user_count"), "id").limit(limit).select("id", "name", "user_count", "last_backfill_page")


def unaudited_deletions(t: Tables, now: int, min_age: int = DAY, max_age: int = 7 * DAY, limit: int | None = 50) -> DataFrame:
    """The latest deletions without an audit; all of them, in no order, if ``limit`` is None. A limit is a top-k in one task."""
    rows = t["articles"].where(F.col("deleted_at").between(now - max_age, now - min_age))
    rows = rows.join(t["deletion_audits"].select("board_id", "url_id"), ["board_id", "url_id"], "left_anti")
    rows = rows if limit is None else rows.orderBy(F.desc("deleted_at"), F.desc("id")).limit(limit)
    return rows.select("id", "board_id", "url_id", "deleted_at")


# status


def insight_stats(t: Tables, now: int, min_net: int = 20, min_age: int = 0) -> DataFrame:
    worth = _worth(min_net) & (F.col("posted_at").isNull() | (F.col("posted_at") < now - min_age))
    total = live(t).agg(F.count_if(worth).alias("total"))
    return t["article_insights"].agg(F.count_if(F.col("error").isNull()).alias("analyzed")).join(F.broadcast(total))


def status(t: Tables, now: int, weekly_budget: int = 140_000) -> DataFrame:
    """One row of figures, each table read once. Digests of today are those of the UTC+8 day."""
    fine = F.col("error").isNull()

    def since(seconds: int) -> Column:
        return F.col("generated_at") > now - seconds

    def credits(when: Column) -> Column:
        used = F.sum(F.when(when, F.col("prompt_tokens") * F.lit(6.9) + F.col("completion_tokens") * F.lit(24.0)))
        return F.coalesce(F.round(used / F.lit(10000.0) * F.lit(0.5)), F.lit(0.0))

    insights = t["article_insights"].agg(
        F.count_if(fine & (F.col("schema_ver") == 2)).alias("v2_total"),
        F.count_if(fine & (F.col("schema_ver") == 1)).alias("v1_remaining"),
        F.count_if(~fine & since(3600)).alias("error_cooldown"),
        F.count_if(fine & since(3600)).alias("last_1h"),
        F.count_if(fine & since(DAY)).alias("last_24h"),
        credits(fine & since(DAY)).alias("credits_24h"),
        credits(fine & since(7 * DAY)).alias("credits_7d"),
    )
    waiting = _with_insight(t).where("deleted_at is null and net_count between 20 and 999999")
    waiting = waiting.where("insight_id is null or schema_ver = 1")
    queue = waiting.agg(
        F.count_if(F.col("posted_at").isNull() | (F.col("posted_at") < now - 7 * DAY)).alias("pending_eligible"),
        F.count_if(F.col("posted_at").between(now - 7 * DAY, now + DAY)).alias("pending_gated"),
    )
    digests = t["board_digests"].agg(F.count_if(F.col("day") == X.local_day(F.lit(now))).alias("digests_today"))
    one = insights.join(F.broadcast(queue)).join(F.broadcast(digests))
    spent = 100.0 * F.col("credits_7d") / F.lit(float(weekly_budget))
    eta = F.when(F.col("last_24h") > 0, F.ceil(F.col("pending_eligible") / F.col("last_24h")).cast("long"))
    return one.withColumn("budget_pct", F.round(spent, 1)).withColumn("drain_days", eta)


def table_counts(t: Tables) -> DataFrame:
    one = t["boards"].agg(F.count("*").alias("boards"))
    for name in ("articles", "pushes", "article_insights"):
        one = one.join(F.broadcast(t[name].agg(F.count("*").alias(name))))
    return one


def health(t: Tables, now: int) -> DataFrame:
    stats = insight_stats(t, now)
    return stats.select(F.to_json(F.struct(F.lit("ok").alias("status"), "analyzed", "total")).alias("body"))


def audit_counters(t: Tables) -> DataFrame:
    """Checked, resurrected and gone; ten or more resurrected raise the alarm."""
    alive, gone = F.count_if(F.col("result") == "alive"), F.count_if(F.col("result") == "gone")
    return t["deletion_audits"].agg(F.count("*").alias("checked"), alive.alias("resurrected"), gone.alias("gone")).withColumn(
        "alarm", F.col("resurrected") >= 10
    )
