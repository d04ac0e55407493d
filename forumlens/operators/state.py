"""State transitions: pure functions from a table and changes to the table's next rows.

They take a whole table as well as the rows of some of a ``Store``'s buckets, as long as these hold the
rows of all keys that change. A row of the changes wins over the table's row; of
several changes to one key the last by the order given wins; without an order one of them does, chosen
by a hash of its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .store import Change, Conflict, Store  # noqa: F401  (part of this module's interface)


def last_of_key(changes: DataFrame, key: tuple[str, ...] | list[str], order: str | None = None) -> DataFrame:
    newest = Window.partitionBy(*key).orderBy(F.desc(order) if order else F.xxhash64(*changes.columns))
    return changes.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def merge(table: DataFrame, changes: DataFrame, key: tuple[str, ...], rules: dict[str, Column], order: str | None = None) -> DataFrame:
    """Full outer join on the key. ``rules`` give a column's value in matched rows, from ``o.`` (old)
    and ``n.`` (new); columns without a rule keep the old value there. New rows take the change's
    columns, null where it has none."""
    old, new = table.alias("o"), last_of_key(changes, key, order).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    joined = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), on, "full")
    out = []
    for c in table.columns:
        fresh = F.col(f"n.{c}") if c in changes.columns else F.lit(None)
        matched = rules.get(c, F.col(f"o.{c}"))
        value = F.when(F.col("o._old").isNull(), fresh).when(F.col("n._new").isNull(), F.col(f"o.{c}")).otherwise(matched)
        out.append(value.cast(table.schema[c].dataType).alias(c))
    return joined.select(*out)


ID_BUCKETS = 1024


def with_ids(changes: DataFrame, table: DataFrame, key: tuple[str, ...], by: str, top: int | None = None) -> DataFrame:
    """Distinct changes with the id of the table's row that they match; new ones get ids beyond the largest,
    each once. ``top`` is the largest id where ``table`` isn't the whole one.

    New rows are numbered within hash buckets of the column ``by``, and buckets follow each other, so numbering
    runs in as many tasks as there are buckets; only the bucket sizes, ID_BUCKETS rows at most, are summed
    up in one place.
    """
    matched = changes.join(table.select(*key, "id"), list(key), "left").select(*changes.columns, "id")
    above = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top")) if top is None else None
    fresh = matched.where("id is null").withColumn("_bucket", F.pmod(F.xxhash64(by), F.lit(ID_BUCKETS)))
    sizes = fresh.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    numbered = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("_bucket").orderBy(by, *key)))
    numbered = numbered.join(F.broadcast(offsets), "_bucket")
    numbered = numbered.withColumn("_top", F.lit(top)) if above is None else numbered.join(F.broadcast(above))
    numbered = numbered.withColumn("id", (F.col("_top") + F.col("_offset") + F.col("_n")).cast("long"))
    return matched.where("id is not null").unionByName(numbered.select(matched.columns))


# boards


def upsert_boards(boards: DataFrame, found: DataFrame, now: int, top: int | None = None) -> DataFrame:
    """Overwrites path, title and user count (also with null); the crawl state stays. New ones are due now."""
    fresh = {
        "next_check_at": F.lit(now), "last_backfill_page": F.lit(1), "backfill_complete": F.lit(False), "check_interval_secs": F.lit(600),
        "backfill_recent_complete": F.lit(False), "is_hot": F.lit(False), "created_at": F.lit(now), "updated_at": F.lit(now),
    }
    changes = found.select(
        "name",
        *((F.col(c) if c in found.columns else F.lit(None)).alias(c) for c in ("category_path", "title", "user_count")),
        *(v.alias(k) for k, v in fresh.items()),
    )
    rules = {c: F.col(f"n.{c}") for c in ("category_path", "title", "user_count", "updated_at")}
    return merge(boards, with_ids(last_of_key(changes, ["name"]), boards, ("name",), "name", top), ("name",), rules)


def set_boards(boards: DataFrame, when: Column, now: int, **values) -> DataFrame:
    """Sets columns of the boards that meet a condition, and when they were updated."""
    values |= {"updated_at": now}
    out = boards
    for c, v in values.items():
        value = v if isinstance(v, Column) else F.lit(v)
        out = out.withColumn(f"_{c}", F.when(when, value.cast(boards.schema[c].dataType)).otherwise(F.col(c)))
    for c in values:
        out = out.withColumn(c, F.col(f"_{c}")).drop(f"_{c}")
    return out


def mark_hot(boards: DataFrame, names: list[str], now: int) -> DataFrame:
    return set_boards(boards, F.col("name").isin(names), now, is_hot=True)


def complete_backfill(boards: DataFrame, ids: list[int], now: int) -> DataFrame:
    return set_boards(boards, F.col("id").isin(ids), now, backfill_complete=True, backfill_recent_complete=True, window_floor=0)


def release_claims(boards: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(boards without claims, how many there were)."""
    held = F.col("backfill_claimed_at").isNotNull()
    return set_boards(boards, held, now, backfill_claimed_at=None), boards.agg(F.count_if(held).alias("released"))


def claim_due_board(boards: DataFrame, now: int) -> tuple[DataFrame, dict | None]:
    """(boards, the claimed one): the longest due hot board, checked next after its interval.

    One driver claims at a time.
    """
    row = boards.where(F.col("is_hot") & (F.col("next_check_at") <= now)).orderBy("next_check_at", "id").first()
    if row is None:
        return boards, None
    after = now + row.check_interval_secs
    return set_boards(boards, F.col("id") == row.id, now, next_check_at=after, last_check_at=now), row.asDict() | {"next_check_at": after}


def claim_backfill_board(boards: DataFrame, window_bottom: int, now: int, claim_secs: int = 21600) -> tuple[DataFrame, dict | None]:
    free = F.col("backfill_claimed_at").isNull() | (F.col("backfill_claimed_at") < now - claim_secs)
    reach = F.col("window_floor").isNull() | (F.col("window_floor") > window_bottom)
    rows = boards.where(~F.col("backfill_complete") & F.col("is_hot") & free & reach)
    row = rows.orderBy(F.col("last_backfill_page") > 1, F.col("user_count").desc_nulls_last(), "id").first()
    if row is None:
        return boards, None
    return set_boards(boards, F.col("id") == row.id, now, backfill_claimed_at=now), row.asDict()


def advance_window(boards: DataFrame, meta: DataFrame, step: int) -> DataFrame:
    """Moves window_bottom back by a step once every unfinished hot board has reached it."""
    bottom = F.broadcast(meta.where("key = 'window_bottom'").select(F.col("value").alias("_bottom")))
    open_ = boards.where(F.col("is_hot") & ~F.col("backfill_complete")).join(bottom)
    behind = F.col("window_floor").isNull() | (F.col("window_floor") > F.col("_bottom"))
    ready = open_.agg((F.count("*") > 0).alias("_some"), (F.count_if(behind) == 0).alias("_all"))
    move = (F.col("key") == "window_bottom") & F.col("_some") & F.col("_all")
    return meta.join(F.broadcast(ready)).select("key", F.when(move, F.col("value") - step).otherwise(F.col("value")).alias("value"))


# articles and pushes

_KEPT = ("id", "board_id", "url_id", "first_seen_at", "posted_at", "url_timestamp", "mark")


def upsert_articles(articles: DataFrame, parsed: DataFrame, now: int, top: int | None = None) -> DataFrame:
    """Overwrites what a page shows and clears the deletion; first seen, posted and mark stay."""
    key = ("board_id", "url_id")
    changes = last_of_key(parsed.drop("id"), key).withColumn("first_seen_at", F.lit(now)).withColumn("last_fetched_at", F.lit(now))
    rules = {c: F.col(f"n.{c}") for c in articles.columns if c not in _KEPT and c in changes.columns}
    rules["deleted_at"] = F.lit(None)
    return merge(articles, with_ids(changes, articles, key, "url_id", top), key, rules)


def update_from_index(articles: DataFrame, entries: DataFrame) -> DataFrame:
    """Sets nrec_raw and mark, also to null, of the articles listed (board_id, url_id, nrec_raw, mark)."""
    known = entries.join(articles.select("board_id", "url_id"), ["board_id", "url_id"], "left_semi")
    return merge(articles, known, ("board_id", "url_id"), {c: F.col(f"n.{c}") for c in ("nrec_raw", "mark")})


def mark_deleted(articles: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    hit = keys.select("board_id", "url_id").distinct().withColumn("_hit", F.lit(True))
    out = articles.join(hit, ["board_id", "url_id"], "left")
    gone = F.when(F.col("deleted_at").isNull() & F.col("_hit"), F.lit(now).cast("long")).otherwise(F.col("deleted_at"))
    return out.withColumn("deleted_at", gone).select(articles.columns)


def resurrect(articles: DataFrame, keys: DataFrame) -> DataFrame:
    hit = keys.select("board_id", "url_id").distinct().withColumn("_hit", F.lit(True))
    out = articles.join(hit, ["board_id", "url_id"], "left")
    return out.withColumn("deleted_at", F.when(F.col("_hit").isNull(), F.col("deleted_at"))).select(articles.columns)


def replace_pushes(pushes: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """All pushes of the touched articles (article_id) are replaced by the fresh ones."""
    kept = pushes.join(touched.select("article_id").distinct(), "article_id", "left_anti")
    return kept.select(pushes.columns).unionByName(fresh.select(pushes.columns))


# insights, entities, digests, audits, runs

INSIGHT_VERSION = 2


def store_insights(insights: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """Writes analyses; key_points and reply_count of an old row stay."""
    changes = results.withColumns({"schema_ver": F.lit(INSIGHT_VERSION), "generated_at": F.lit(now), "error": F.lit(None).cast("string")})
    kept = ("article_id", "key_points", "reply_count")
    rules = {c: F.col(f"n.{c}") for c in insights.columns if c in changes.columns and c not in kept}
    return merge(insights, changes, ("article_id",), rules)


def mark_insight_errors(insights: DataFrame, errors: DataFrame, now: int) -> DataFrame:
    """(article_id, error): an old row keeps its content, a new one says that the analysis failed."""
    changes = errors.select(
        "article_id", X.truncate_error(F.col("error")).alias("error"), F.lit("(分析失敗)").alias("tldr"), F.lit("error").alias("model"),
        F.lit(1).alias("schema_ver"), F.lit(now).alias("generated_at"),
    )
    return merge(insights, changes, ("article_id",), {c: F.col(f"n.{c}") for c in ("error", "generated_at")})


def entity_refs_of(insights: DataFrame) -> DataFrame:
    """Entity rows of analyses without an error; of equal names in an article the first one counts."""
    rows = insights.where("error is null and entities is not null and entities <> '[]'")
    each = rows.select("article_id", F.posexplode(X.parse_entities(F.col("entities"))).alias("pos", "e"))
    each = each.withColumn("name_norm", X.norm_entity(F.col("e.name"))).where("name_norm <> ''")
    first = Window.partitionBy("article_id", "name_norm").orderBy("pos")
    kind = F.left(F.coalesce(F.nullif(F.col("e.type"), F.lit("")), F.lit("其他")), F.lit(10))
    named = each.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return named.select("name_norm", F.left(X.trimmed(F.col("e.name")), F.lit(60)).alias("name"), kind.alias("kind"), "article_id")


def sync_entity_refs(refs: DataFrame, changed: DataFrame) -> DataFrame:
    """Replaces the entity rows of the articles whose insights changed."""
    kept = refs.join(changed.select("article_id").distinct(), "article_id", "left_anti")
    return kept.select(refs.columns).unionByName(entity_refs_of(changed))


def store_digests(digests: DataFrame, fresh: DataFrame) -> DataFrame:
    rules = {c: F.col(f"n.{c}") for c in digests.columns if c in fresh.columns and c not in ("board_id", "day")}
    return merge(digests, fresh, ("board_id", "day"), rules)


def record_audits(audits: DataFrame, fresh: DataFrame) -> DataFrame:
    return merge(audits, fresh, ("board_id", "url_id"), {c: F.col(f"n.{c}") for c in ("checked_at", "result")})


def start_run(runs: DataFrame, run_id: int, board_id: int | None, run_type: str, now: int) -> DataFrame:
    row = runs.sparkSession.createDataFrame([(run_id, board_id, run_type, now)], "id long, board_id long, run_type string, started_at long")
    return runs.unionByName(row.withColumn("status", F.lit("running")), allowMissingColumns=True)


def finish_run(runs: DataFrame, run_id: int, status: str, now: int, **counters) -> DataFrame:
    values = {"status": F.lit(status), "finished_at": F.lit(now), **{k: F.lit(v) for k, v in counters.items()}}
    own = F.col("id") == run_id
    return runs.withColumns({c: F.when(own, v.cast(runs.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})
