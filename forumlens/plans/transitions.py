"""Registered queries for writes, parsers, ingest steps, the worker and streams, with their DuckDB oracles.

Each applies the library's function to the adapter's tables; pages and answers are made of those tables first, so that
what is read from them is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import enrich as E
from ..operators import ingest as I
from ..operators import reads as R
from ..operators import state as S
from ..schemas import TABLES, duplicate_keys, orphans
from ..sources.adapter import NOW
from ..sources.folders import shared_folder
from ..streaming import ingest as SI
from ..streaming import queue as Q
from .registry import _LISTED, _LIVE, _listing, _with_schema, query

DAY = 86400


# boards


@query(
    "upsert_boards",
    """select id, name, case when id % 3 = 0 then 'path' else category_path end as category_path, case when id % 3 <> 0 then title end as title,
       case when id % 3 = 0 then user_count + 1 else user_count end as user_count, next_check_at, check_interval_secs, last_backfill_page, is_hot,
       backfill_complete, case when id % 3 = 0 then {now} end as updated_at, true as known from boards
       union all select null, 'NEW_' || name, null, 'new', 7, {now}, 600, 1, false, false, {now}, false from boards""",
)
def upsert_boards(t, now):
    boards = _with_schema(t, "boards")
    seen = boards.where("id % 3 = 0").select("name", F.lit("path").alias("category_path"), F.lit(None).cast("string").alias("title"), (F.col("user_count") + 1).alias("user_count"))
    new = boards.select(F.concat(F.lit("NEW_"), "name").alias("name"), F.lit(None).cast("string").alias("category_path"), F.lit("new").alias("title"), F.lit(7).cast("long").alias("user_count"))
    out = S.upsert_boards(boards, seen.unionByName(new), now)
    known = F.col("id") <= F.lit(boards.agg(F.max("id")).first()[0])
    # new boards get ids beyond the others, each its own
    rows = out.withColumn("known", known).dropDuplicates(["id"])
    return rows.select(
        F.when(F.col("known"), F.col("id")).alias("id"), "name", "category_path", "title", "user_count", "next_check_at", "check_interval_secs",
        "last_backfill_page", "is_hot", "backfill_complete", "updated_at", "known",
    )


@query(
    "board_settings",
    """select id, case when id in (2, 3) then true else backfill_complete end as backfill_complete, case when id in (2, 3) then 0 else window_floor end as window_floor,
       is_hot or id in (4, 9, 14) as is_hot, case when id % 5 = 1 then 999 else check_interval_secs end as check_interval_secs,
       case when id % 5 = 1 then {now} - 1 when id in (2, 3, 4, 9, 14) then {now} end as updated_at from boards""",
)
def board_settings(t, now):
    boards = S.set_boards(_with_schema(t, "boards"), F.expr("id % 5 = 1"), now - 1, check_interval_secs=999)
    boards = S.mark_hot(S.complete_backfill(boards, [2, 3], now), ["NATION_4", "NATION_9", "NATION_14"], now)
    return boards.select("id", "backfill_complete", "window_floor", "is_hot", "check_interval_secs", "updated_at")


@query(
    "claimed_due_board",
    """with c as (select id, check_interval_secs from boards where is_hot and next_check_at <= {now} order by next_check_at, id limit 1)
       select b.id, case when c.id is not null then {now} + c.check_interval_secs else b.next_check_at end as next_check_at,
       case when c.id is not null then {now} end as last_check_at from boards b left join c on c.id = b.id""",
)
def claimed_due_board(t, now):
    return S.claim_due_board(_with_schema(t, "boards"), now)[0].select("id", "next_check_at", "last_check_at")


@query(
    "claimed_backfill_board",
    """with c as (select id from boards where not backfill_complete and is_hot and (backfill_claimed_at is null or backfill_claimed_at < {now} - 21600)
       and (window_floor is null or window_floor > {now} - 17280000) order by last_backfill_page > 1, user_count desc, id limit 1)
       select b.id, case when c.id is not null then {now} else b.backfill_claimed_at end as backfill_claimed_at from boards b left join c on c.id = b.id""",
)
def claimed_backfill_board(t, now):
    return S.claim_backfill_board(_with_schema(t, "boards"), now - 200 * DAY, now)[0].select("id", "backfill_claimed_at")


@query(
    "advanced_window",
    """select 'window_bottom' as key, {now} - 86400 as reached,
       case when count(*) > 0 and count(*) filter (window_floor is null or window_floor > {now}) = 0 then {now} - 86400 else {now} end as all_boards,
       case when count(*) > 0 and count(*) filter (window_floor is null or window_floor > 5) = 0 then 5 - 86400 else 5 end as far_back
       from boards where is_hot and not backfill_complete""",
)
def advanced_window(t, now):
    boards, spark = _with_schema(t, "boards"), t["boards"].sparkSession

    def moved(rows: DataFrame, bottom: int, name: str) -> DataFrame:
        meta = spark.createDataFrame([("window_bottom", bottom)], TABLES["backfill_meta"].schema)
        return S.advance_window(rows, meta, DAY).withColumnRenamed("value", name)

    out = moved(boards.where("window_floor is not null"), now, "reached")
    return out.join(moved(boards, now, "all_boards"), "key").join(moved(boards, 5, "far_back"), "key")


# articles, insights, entities, digests, audits, runs


@query(
    "index_updates",
    """select id, case when id % 3 <> 1 and id % 4 = 0 then '9' end as nrec_raw, case when id % 3 = 1 then mark when id % 6 = 0 then '!' end as mark from articles""",
)
def index_updates(t, now):
    seen = _listing(t).select("board_id", "url_id", X.empty_to_null(F.col("nrec_raw")).alias("nrec_raw"), X.empty_to_null(F.col("mark")).alias("mark"))
    unknown = seen.limit(1).withColumn("url_id", F.lit("M.0.A.NONE"))
    return S.update_from_index(_with_schema(t, "articles"), seen.unionByName(unknown)).select("id", "nrec_raw", "mark")


@query(
    "stored_insights",
    """select article_id, case when article_id % 4 = 1 then 'again' else tldr end as tldr, case when article_id % 4 = 1 then '負面' else sentiment end as sentiment,
       key_points, community_take, case when article_id % 4 <> 1 then error end as error, case when article_id % 4 = 1 then 2 else schema_ver end as schema_ver,
       case when article_id % 4 = 1 then {now} else generated_at end as generated_at, case when article_id % 4 = 1 then 5 else prompt_tokens end as prompt_tokens
       from article_insights
       union all select id, 'again', '負面', null, null, null, 2, {now}, 5 from articles where id % 3 = 0 and id % 4 = 1""",
)
def stored_insights(t, now):
    results = t["articles"].where("id % 4 = 1").select(F.col("id").alias("article_id"), F.lit("again").alias("tldr"), F.lit("負面").alias("sentiment"), F.lit(5).cast("long").alias("prompt_tokens"))
    out = S.store_insights(_with_schema(t, "article_insights"), results, now)
    return out.select("article_id", "tldr", "sentiment", "key_points", "community_take", "error", "schema_ver", "generated_at", "prompt_tokens")


_NAMED = """select 'n' || article_id as name_norm, 'N' || article_id as name, '人物' as kind, article_id from article_insights where error is null and article_id % 6 = 1
    union all select 'm', 'M', '其他', article_id from article_insights where error is null and article_id % 6 = 1"""

query("entity_backfill", _NAMED)(lambda t, now: S.entity_refs_of(_with_schema(t, "article_insights")))


@query(
    "entity_sync",
    f"""select name_norm, name, kind, article_id from entity_refs where article_id not in (select article_id from article_insights where article_id % 6 = 1)
        union all {_NAMED}""",
)
def entity_sync(t, now):
    return S.sync_entity_refs(t["entity_refs"].select("name_norm", "name", "kind", "article_id"), _with_schema(t, "article_insights").where("article_id % 6 = 1"))


@query(
    "stored_digests",
    """select coalesce(d.board_id, b.id) as board_id, coalesce(d.day, '2001-08-02') as day, case when b.id is not null then 'again' else d.digest end as digest,
       case when b.id is not null then 9 else d.article_count end as article_count
       from board_digests d full join (select id from boards where is_hot) b on b.id = d.board_id and d.day = '2001-08-02'""",
)
def stored_digests(t, now):
    fresh = t["boards"].where("is_hot").select(F.col("id").alias("board_id"), F.lit("2001-08-02").alias("day"), F.lit("again").alias("digest"), F.lit(9).cast("long").alias("article_count"))
    return S.store_digests(_with_schema(t, "board_digests"), fresh).select("board_id", "day", "digest", "article_count")


@query(
    "recorded_audits",
    """select coalesce(d.board_id, a.board_id) as board_id, coalesce(d.url_id, a.url_id) as url_id, case when a.url_id is not null then {now} else d.checked_at end as checked_at,
       case when a.url_id is not null then 'alive' else d.result end as result
       from deletion_audits d full join (select board_id, url_id from articles where deleted_at is not null and id % 30 = 0) a on a.board_id = d.board_id and a.url_id = d.url_id""",
)
def recorded_audits(t, now):
    fresh = t["articles"].where("deleted_at is not null and id % 30 = 0").select("board_id", "url_id", F.lit(now).cast("long").alias("checked_at"), F.lit("alive").alias("result"))
    return S.record_audits(_with_schema(t, "deletion_audits"), fresh)


@query(
    "crawl_runs",
    """select id, id as board_id, 'incremental' as run_type, case when id = 7 then 'completed' else 'running' end as status, case when id = 7 then 2 end as pages_crawled,
       case when id = 7 then 4 end as articles_new, next_check_at as started_at, case when id = 7 then {now} end as finished_at from boards
       union all select 1000, 3, 'backfill', 'running', null, null, {now}, null""",
)
def crawl_runs(t, now):
    runs = t["boards"].select("id", F.col("id").alias("board_id"), F.lit("incremental").alias("run_type"), F.lit("running").alias("status"), F.col("next_check_at").alias("started_at"))
    whole = runs.select(*((F.col(f.name) if f.name in runs.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES["crawl_runs"].schema))
    out = S.finish_run(S.start_run(whole, 1000, 3, "backfill", now), 7, "completed", now, pages_crawled=2, articles_new=4)
    return out.select("id", "board_id", "run_type", "status", "pages_crawled", "articles_new", "started_at", "finished_at")


@query("cut_errors", "select id as article_id, repeat('x', 300) as error, '(分析失敗)' as tldr from articles where id % 3 = 0")
def cut_errors(t, now):
    errors = t["articles"].where("id % 3 = 0").select(F.col("id").alias("article_id"), F.repeat(F.lit("x"), F.lit(400)).alias("error"))
    return S.mark_insight_errors(_with_schema(t, "article_insights").where("false"), errors, now).select("article_id", "error", "tldr")


@query(
    "sound_tables",
    """select * from (values ('articles', 0, 0), ('pushes', 0, 0), ('article_insights', 0, 0)) v(name, repeated, lost)
       union all select 'again', (select count(*) from articles), (select count(*) from pushes where article_id % 2 = 0)""",
)
def sound_tables(t, now):
    def row(name: str, table: str, tables: dict) -> DataFrame:
        repeated = duplicate_keys(table, tables[table]).agg(F.count("*").alias("repeated"))
        lost = orphans("pushes" if table == "again" else table, tables).agg(F.count("*").alias("lost"))
        return repeated.join(F.broadcast(lost)).select(F.lit(name).alias("name"), "repeated", "lost")

    whole = {name: t[name] for name in ("boards", "articles", "pushes", "article_insights")}
    out = row("articles", "articles", whole).unionByName(row("pushes", "pushes", whole)).unionByName(row("article_insights", "article_insights", whole))
    twice = duplicate_keys("articles", t["articles"].unionByName(t["articles"])).agg(F.count("*").alias("repeated"))
    odd = orphans("pushes", whole | {"articles": t["articles"].where("id % 2 = 1")}).agg(F.count("*").alias("lost"))
    return out.unionByName(twice.join(F.broadcast(odd)).select(F.lit("again").alias("name"), "repeated", "lost"))


@query(
    "bucketed_upsert",
    """with ten as (select id from articles order by id limit 10)
       select a.id, a.board_id, a.url_id, case when ten.id is not null then 'edited' else a.title end as title,
       case when ten.id is not null then {now} else a.last_fetched_at end as last_fetched_at, true as few_buckets from articles a left join ten on ten.id = a.id""",
)
def bucketed_upsert(t, now):
    """A store in buckets, an upsert of ten articles, and the table after it; few_buckets: no more than ten were rewritten."""
    spark = t["articles"].sparkSession
    store = S.Store(spark, shared_folder(spark, "store"), {"articles": 32})
    store.commit(articles=_with_schema(t, "articles"))
    ten = store.read("articles").orderBy("id").limit(10).select("board_id", "url_id", F.lit("edited").alias("title"))
    before = store.parts("articles")
    store.retry(lambda c: c.update("articles", ten, lambda old: S.upsert_articles(old, ten, now, c.top("articles"))))
    few = sum(before.get(b) != p for b, p in store.parts("articles").items()) <= 10
    return store.read("articles").select("id", "board_id", "url_id", "title", "last_fetched_at", F.lit(few).alias("few_buckets"))


# links, times, pages


@query(
    "article_links",
    """select a.id, case when a.id % 5 <> 0 then b.name end as board, case when a.id % 5 <> 0 then a.url_id end as url_id, case when a.id % 5 <> 0 then a.posted_at end as url_timestamp,
       '/bbs/' || b.name || '/index' || case when a.id % 4 > 0 then cast(a.id % 4 as varchar) else '' end || '.html' as page, a.posted_at as shown_at
       from articles a join boards b on b.id = a.board_id""",
)
def article_links(t, now):
    rows = t["articles"].join(R._boards(t), "board_id")
    url = F.when(F.expr("id % 5 = 0"), F.concat(F.lit("/bbs/"), "board", F.lit("/index7.html"))).otherwise(X.article_url(F.col("board"), F.col("url_id")))
    shown = X.posted_at(X.article_time(F.col("posted_at")))  # printed and read again
    rows = rows.select("id", X.article_url_parts(url).alias("p"), X.index_url(F.col("board"), F.expr("id % 4")).alias("page"), shown.alias("shown_at"))
    return rows.select("id", "p.board", "p.url_id", "p.url_timestamp", "page", "shown_at")


@query(
    "shown_classes",
    """select id, case when id % 6 = 0 then '' when id % 6 = 1 then 'c-f1' when id % 6 = 2 then 'c-f1' when id % 60 >= 10 then 'c-f3' when id % 60 >= 1 then 'c-f2' else '' end as nrec,
       case id % 3 when 0 then 'c-f1' when 1 then 'c-f3' else 'c-white' end as users,
       '&lt;a href=&quot;x&quot;&gt;' || id || ' &amp;amp; it&#39;s' as escaped from articles""",
)
def shown_classes(t, now):
    nrec = F.expr("case id % 6 when 0 then '' when 1 then '爆' when 2 then 'X3' else cast(id % 60 as string) end")
    users = F.expr("case id % 3 when 0 then 'hl f1' when 1 then 'hl f3' else 'hl' end")
    raw = F.concat(F.lit('<a href="x">'), F.col("id").cast("string"), F.lit(" &amp; it's"))
    return t["articles"].select("id", X.nrec_class(nrec).alias("nrec"), X.user_count_color(users).alias("users"), X.html_escape(raw).alias("escaped"))


_ENTRIES = """select id, board_id, url_id, posted_at, mark, 'a & <b> "' || id || '"' as title, id % 13 = 5 as deleted, coalesce(author, '') as author,
    case when id % 4 = 0 then cast(id % 90 as varchar) else '' end as nrec, (row_number() over (partition by board_id order by id) - 1) // 20 + 1 as page,
    (row_number() over (partition by board_id order by id) - 1) % 20 as pos from articles"""


def _div(name: str, *parts) -> F.Column:
    return F.concat(F.lit(f'<div class="{name}">'), *parts, F.lit("</div>"))


def _index_pages(t) -> DataFrame:
    """Index pages of twenty articles each, as the site would show them."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("board_id").orderBy("id")) - 1
    rows = t["articles"].join(R._boards(t), "board_id").withColumns({"page": (place / 20).cast("int") + 1, "pos": place % 20})
    title = X.html_escape(F.concat(F.lit('a & <b> "'), F.col("id").cast("string"), F.lit('"')))
    link = F.concat(F.lit('<a href="'), X.article_url(F.col("board"), F.col("url_id")), F.lit('">'), title, F.lit("</a>"))
    nrec = F.expr("if(id % 4 = 0, concat('<span>', id % 90, '</span>'), '')")
    entry = _div(
        "r-ent", _div("nrec", nrec), _div("title", F.when(F.expr("id % 13 = 5"), title).otherwise(link)),
        _div("meta", _div("author", F.coalesce("author", F.lit(""))), _div("mark", F.coalesce("mark", F.lit("")))),
    )
    bodies = rows.groupBy("board_id", "board", "page").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e"))))["e"], "\n").alias("list"))
    older = F.concat(F.lit('<div class="btn-group-paging"><a href="/bbs/'), "board", F.lit("/index"), (F.col("page") + 6).cast("string"), F.lit('.html">&lsaquo; 上頁</a></div>'))
    return bodies.select("board_id", "page", F.concat(older, "list").alias("body"))


@query(
    "index_entries",
    f"""select board_id, page, page + 7 as max_page, pos, case when deleted then '' else url_id end as url_id, title, author, nrec as nrec_raw, coalesce(mark, '') as mark, deleted,
        case when not deleted then posted_at end as url_timestamp from ({_ENTRIES})""",
)
def index_entries(t, now):
    return I.index_entries(_index_pages(t)).drop("date")


def _line(name: str, value: F.Column) -> F.Column:
    return _div("article-metaline", F.lit(f'<span class="article-meta-tag">{name}</span><span class="article-meta-value">'), value, F.lit("</span>"))


def _article_pages(t) -> DataFrame:
    """Article pages with their pushes, as the site would show them."""

    def span(name: str, value: F.Column) -> F.Column:
        return F.concat(F.lit(f'<span class="{name}">'), value, F.lit("</span>"))

    push = _div("push", span("push-tag", F.concat("tag", F.lit(" "))), span("push-userid", F.col("user_id")), span("push-content", F.concat(F.lit(": "), "content")), span("push-ipdatetime", F.concat(F.lit(" "), "ipdatetime")))
    said = t["pushes"].groupBy("article_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", push.alias("p"))))["p"], "").alias("said"))
    rows = t["articles"].join(R._boards(t), "board_id").join(said, F.col("id") == F.col("article_id"), "left")
    sent = F.when(F.col("ip").isNotNull(), F.concat(F.lit('<span class="f2">※ 發信站: x ('), "ip", F.lit(")</span>\n"))).otherwise("")
    body = F.concat(
        F.lit('<div id="main-content">'), _line("作者", F.concat("author", F.lit(" (nick)"))), _line("標題", F.coalesce("title", F.lit(""))), _line("時間", X.article_time(F.col("posted_at"))),
        F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n--<br>\n"), sent, F.coalesce("said", F.lit("")), F.lit("</div>"),
    )
    return rows.select(F.col("id").alias("article_id"), "board_id", X.article_url(F.col("board"), F.col("url_id")).alias("url"), body.alias("body"), F.lit("").alias("nrec_raw"), F.coalesce("mark", F.lit("")).alias("mark"))


_PAGE_COLUMNS = ("board_id", "url_id", "url_timestamp", "posted_at", "title", "author", "content", "ip", "mark", "nrec_raw", "push_count", "boo_count", "neutral_count", "net_count")


@query(
    "article_pages",
    """select board_id, url_id, url_timestamp, posted_at, title, author, coalesce(content || chr(10), '') || '--' as content, ip, mark, cast(null as varchar) as nrec_raw,
       coalesce(p, 0) as push_count, coalesce(b, 0) as boo_count, coalesce(n, 0) as neutral_count, coalesce(p, 0) - coalesce(b, 0) as net_count
       from articles left join (select article_id, count(*) filter (tag = '推') as p, count(*) filter (tag = '噓') as b, count(*) filter (tag = '→') as n from pushes group by 1) c on c.article_id = id""",
)
def article_pages(t, now):
    return I.articles_of(_article_pages(t))[0].select(*_PAGE_COLUMNS)


@query("page_pushes", "select a.url_id, p.seq, p.tag, p.user_id, p.content, p.ipdatetime from pushes p join articles a on a.id = p.article_id")
def page_pushes(t, now):
    parsed = I.articles_of(_article_pages(t))[0]
    # an article's address stands for its id
    return I.pushes_of(parsed.withColumn("article_id", F.col("url_id"))).withColumnRenamed("article_id", "url_id")


@query("failed_pages", "select id, case when id % 2 = 0 then 'invalid article URL: /bbs/x/index.html' else '#main-content not found' end as error from articles where id % 3 = 0")
def failed_pages(t, now):
    url = F.expr("if(id % 2 = 0, '/bbs/x/index.html', concat('/bbs/x/', url_id, '.html'))")
    pages = t["articles"].where("id % 3 = 0").select(F.col("id").alias("board_id"), url.alias("url"), F.lit("<p>").alias("body"), F.lit("").alias("nrec_raw"), F.lit("").alias("mark"))
    return I.articles_of(pages)[1].select(F.col("board_id").alias("id"), "error")


def _site(t) -> DataFrame:
    """Category pages: regions, their nations, and suppliers as boards."""
    link = '<div class="b-ent"><a class="board" href="{}"><div class="board-name">{}</div><div class="board-nuser">{}</div><div class="board-title">{}</div></a></div>'

    def entries(rows: DataFrame, url: str, href: str, name: str, users: str, title: str) -> DataFrame:
        parts = link.split("{}")
        html = F.concat(F.lit(parts[0]), F.expr(href), F.lit(parts[1]), F.expr(name), F.lit(parts[2]), F.expr(users), F.lit(parts[3]), F.expr(title), F.lit(parts[4]))
        return rows.groupBy(F.expr(url).alias("url")).agg(F.array_join(F.array_sort(F.collect_list(html)), "\n").alias("body"))

    top = entries(t["region"], "'/cls/1'", "concat('/cls/r', r_regionkey)", "r_name", "'0'", "''")
    middle = entries(t["nation"], "concat('/cls/r', n_regionkey)", "concat('/cls/n', n_nationkey)", "n_name", "'0'", "''")
    boards = entries(t["supplier"], "concat('/cls/n', s_nationkey)", "concat('/bbs/B', s_suppkey, '/index.html')", "concat('B', s_suppkey)", "cast(s_suppkey % 9 as string)", "concat('title of ', s_name)")
    return top.unionByName(middle).unionByName(boards)


@query(
    "discovery",
    """select 'B' || s_suppkey as name, case when s_suppkey % 7 = 0 then 'hot' else 'title of ' || s_name end as title,
       case when s_suppkey % 7 = 0 then 100 + s_suppkey else nullif(s_suppkey % 9, 0) end as user_count,
       case when s_nationkey is not null then r_name || ' > ' || n_name || ' > B' || s_suppkey end as category_path, s_suppkey % 7 = 0 as is_hot
       from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey
       union all select 'B-only-hot', 'hot', 5, null, true""",
)
def discovery(t, now):
    """A walk over pages made of regions, nations and suppliers, with the hot list."""
    spark, site = t["supplier"].sparkSession, _site(t)
    entry = '<div class="b-ent"><a><div class="board-name">{}</div><div class="board-nuser"><span class="hl">{}</span></div><div class="board-title">hot</div></a></div>'
    a, b, c = entry.split("{}")
    listed = t["supplier"].where("s_suppkey % 7 = 0").select(F.concat(F.lit(f"{a}B"), "s_suppkey", F.lit(b), (F.col("s_suppkey") + 100).cast("string"), F.lit(c)).alias("e"))
    hot = listed.agg(F.concat(F.array_join(F.collect_list("e"), "\n"), F.lit(entry.format("B-only-hot", 5))).alias("body"))
    folder = shared_folder(spark, "site")
    site.write.parquet(folder)  # each level reads its pages only
    return I.discover(lambda urls: spark.read.schema("url string, body string").parquet(folder).where(F.col("url").isin(urls)), hot=hot)


# ingest steps


@query(
    "next_intervals",
    f"""select b.id as board_id, case when bool_or(a.id % 8 = 0 and b.id % 2 = 1) then 120 else 1200 end as check_interval_secs,
        {{now}} + case when bool_or(a.id % 8 = 0 and b.id % 2 = 1) then 120 else 1200 end as next_check_at
        from {_LISTED} l join articles a on a.board_id = l.board_id and a.url_id = l.url_id join boards b on b.id = a.board_id where not l.deleted group by 1""",
)
def next_intervals(t, now):
    known = t["articles"].where("id % 8 <> 0 or board_id % 2 = 0").withColumn("nrec_raw", F.lit(None).cast("string"))
    return I.next_intervals(t["boards"], I.entry_actions(_listing(t), known), now)


_PAGED = f"(select *, 6 - ntile(5) over (partition by board_id order by url_timestamp desc, url_id) as page from {_LISTED} l)"
_STEP = """with oldest as (select board_id, page, coalesce(min(url_timestamp) filter (not deleted and mark <> '!'), 0) as oldest from {paged} p group by 1, 2),
    stops as (select board_id, max(page) filter (oldest > 0 and oldest < {bottom}) as stop from oldest group by 1)
    select o.board_id, min(page) as last_backfill_page, case when stop is null then 0 else arg_min(nullif(oldest, 0), page) end as window_floor,
    stop is null as complete, stop is not null as at_boundary from oldest o join stops s using (board_id) where page >= coalesce(stop, 1) group by 1, stop"""
_BOTTOM = NOW - 1100 * DAY


@query("backfill_steps", _STEP.replace("{paged}", _PAGED).replace("{bottom}", str(_BOTTOM)))
def backfill_steps(t, now):
    from pyspark.sql import Window

    part = F.ntile(5).over(Window.partitionBy("board_id").orderBy(F.desc("url_timestamp"), "url_id"))
    return I.backfill_step(_listing(t).withColumn("page", 6 - part), _BOTTOM, 5, 1)


_CUT = NOW - 700 * DAY


def _shown(condition: str) -> str:
    return f"(select board_id, url_id, posted_at as url_timestamp from articles where id % 13 <> 5 and {condition})"


_AGAIN, _BEFORE = _shown(f"posted_at > {_CUT} and (id % 3 <> 1 or id % 12 = 1)"), _shown(f"posted_at <= {_CUT}")


@query(
    "vanished",
    f"""with missing as (select a.board_id, a.url_id, a.url_timestamp, a.id from articles a
            join (select board_id, min(url_timestamp) as oldest, max(url_timestamp) as newest from {_AGAIN} g group by 1) o on o.board_id = a.board_id
            join (select board_id, max(url_timestamp) as before from {_BEFORE} p group by 1) p on p.board_id = a.board_id
            where a.{_LIVE} and a.url_timestamp > oldest and a.url_timestamp <= newest and a.url_timestamp > before
            and not exists (select 1 from {_AGAIN} g where g.board_id = a.board_id and g.url_id = a.url_id)
            and not exists (select 1 from {_BEFORE} p where p.board_id = a.board_id and p.url_id = a.url_id))
        select board_id, url_id from missing where id % 2 = 0 and board_id in (select board_id from missing group by 1 having count(*) <= 60)""",
)
def vanished(t, now):
    every = t["articles"].where("id % 13 <> 5")
    columns = ("board_id", "url_id", F.col("posted_at").alias("url_timestamp"), F.lit(False).alias("deleted"), F.lit("").alias("mark"))
    recent = every.where(F.col("posted_at") > _CUT)
    first = recent.where("id % 3 <> 1").select(*columns, F.lit(2).alias("page"))
    again = recent.where("id % 3 <> 1 or id % 12 = 1").select(*columns, F.lit(2).alias("page"))
    before = every.where(F.col("posted_at") <= _CUT).select(*columns, F.lit(1).alias("page"))
    statuses = t["articles"].select("board_id", "url_id", F.expr("if(id % 2 = 0, 404, 200)").alias("status"))
    return I.vanished(t["articles"], first, again, before, statuses, guard=60)


@query(
    "audit_results",
    """select board_id, url_id, {now} as checked_at, case id % 3 when 0 then 'alive' else 'gone' end as result from articles a
       where deleted_at between {now} - 315360000 and {now} - 86400 and id % 3 <> 2
       and not exists (select 1 from deletion_audits d where d.board_id = a.board_id and d.url_id = a.url_id)""",
)
def audit_results(t, now):
    due = R.unaudited_deletions(t, now, max_age=3650 * DAY, limit=None)
    statuses = t["articles"].select("board_id", "url_id", F.expr("case id % 3 when 0 then 200 when 1 then 404 else 503 end").alias("status"))
    return I.audit_results(due, statuses, now)


# answers


@query(
    "article_prompts",
    f"""select a.id as article_id, '標題：' || coalesce(nullif(a.title, ''), '(無標題)') || chr(10) || '作者：' || a.author || chr(10) || chr(10) || '--- 文章內容 ---' || chr(10) ||
        coalesce(a.content, '') || chr(10) || case when p.n is null then chr(10) || '--- 推文：（無）---'
        else chr(10) || '--- 推文（共 ' || p.n || ' 則' || case when p.n > 500 then '，僅顯示前 500 則' else '' end || '）---' || chr(10) || p.said end as prompt
        from articles a left join (select article_id, count(*) as n, string_agg(tag || ' ' || user_id || ': ' || content, chr(10) order by seq) filter (seq < 500) as said
        from pushes group by 1) p on p.article_id = a.id where a.{_LIVE}""",
)
def article_prompts(t, now):
    said = R.first_pushes(t["pushes"]).withColumnRenamed("article_id", "id")
    return E.with_prompts(R.live(t).select("id", "title", "author", "content").join(said, "id", "left"))


#: answers by id % 5, with any type in any place; ID is the article's id
_ANSWERS = (
    '```json\n{"tldr":" T_ID ","community_take":7,"sentiment":"偏正面","controversy":"高度","article_type":"這是問卦文","entities":[{"name":" A_ID ","type":"人物"},{"name":""},7,{"name":"B","type":null}],'
    '"push_stance":{"pro":150,"con":-5,"neutral":"x"},"tags":["a",1,"b"],"top_comments":["p",2,"q"],"ad_likelihood":"高度疑似","factuality":"事實","ai_generated":"疑似"}\n```',
    "not json",
    '{"tldr":" "}',
    '{"tldr":5}',
    'so: {"tldr":"t","push_stance":{"pro":33.5,"con":0.4,"neutral":true},"sentiment":7,"controversy":"中等","entities":{"name":"x"},"tags":"a","qa_summary":" q "} done',
)


def _same(prompt: str) -> tuple[str, int, int]:
    """A model that answers with what it is asked."""
    return prompt, 1, 2


@query(
    "read_answers",
    """select id as article_id, error, tldr, community_take, top_comments, sentiment, controversy, tags, article_type, replace(entities, '_ID', cast(id as varchar)) as entities, ad_likelihood, factuality,
       ai_generated, push_stance, qa_summary from (select id, v.* exclude (k, tldr), replace(v.tldr, '_ID', cast(id as varchar)) as tldr from articles join (values
       (0, false, 'T_ID', '', 'p' || chr(10) || 'q', '正面', '高', '["a", "b"]', '問卦', '[{"name": "A_ID", "type": "人物"}, {"name": "B", "type": "其他"}]', '高度', '事實', '疑似AI', '{"pro": 100, "con": 0, "neutral": 0}', ''),
       (1, true, null, null, null, null, null, null, null, null, null, null, null, null, null), (2, true, null, null, null, null, null, null, null, null, null, null, null, null, null),
       (3, true, null, null, null, null, null, null, null, null, null, null, null, null, null),
       (4, false, 't', '', '', '中立', '中', '[]', '其他', '[]', '無', '觀點', '不確定', '{"pro": 34, "con": 0, "neutral": 0}', 'q')
       ) v(k, error, tldr, community_take, top_comments, sentiment, controversy, tags, article_type, entities, ad_likelihood, factuality, ai_generated, push_stance, qa_summary) on v.k = id % 5)""",
)
def read_answers(t, now):
    answers = F.array(*(F.lit(a) for a in _ANSWERS))
    prompt = F.replace(F.get(answers, F.expr("cast(id % 5 as int)")), F.lit("_ID"), F.col("id").cast("string"))
    out = E.analyze(t["articles"].select(F.col("id").alias("article_id"), prompt.alias("prompt")), _same, concurrency=3)
    return out.withColumn("error", F.col("error").startswith("parse llm output") & F.col("error").isNotNull()).select(
        "article_id", F.coalesce("error", F.lit(False)).alias("error"), "tldr", "community_take", "top_comments", "sentiment", "controversy", "tags", "article_type", "entities",
        "ad_likelihood", "factuality", "ai_generated", "push_stance", "qa_summary",
    )


def _first_line(prompt: str) -> tuple[str, int, int]:
    return prompt.split("\n", 1)[0], len(prompt), 3


@query(
    "digest_batch",
    f"""select d.board_id, d.day, d.digest, d.article_count from board_digests d
        union all select c.board_id, '2001-08-03', '看板：' || b.name, c.n from
        (select board_id, least(15, count(*)) as n from articles a join article_insights i on i.article_id = a.id
         where a.{_LIVE} and i.error is null and i.generated_at > {{now}} - 15552000 group by 1 having count(*) >= 3) c join boards b on b.id = c.board_id where b.is_hot""",
)
def digest_batch(t, now):
    open_ = R.boards_without_digest(t, "2001-08-03").select(F.col("id").alias("board_id"))
    prompts = R.digest_prompts(t, now - 180 * DAY).join(open_, "board_id", "left_semi")
    made = E.digests(prompts, "2001-08-03", now, _first_line, "m", concurrency=3)
    return S.store_digests(_with_schema(t, "board_digests"), made).select("board_id", "day", "digest", "article_count")


# streams


def _as_stream(spark, folder: str, schema, *lots: DataFrame):
    """Writes lots of rows one after the other, and gives a stream over them after each."""
    for lot in lots:
        lot.write.mode("append").parquet(f"{folder}/rows")
        yield spark.readStream.schema(schema).parquet(f"{folder}/rows")


@query("once_events", "select event_type, count(*) as n, count(distinct event_id) as events from events group by 1")
def once_events(t, now):
    """Events that land twice, through a stream that lets each pass once."""
    spark = t["events"].sparkSession
    folder, events = shared_folder(spark, "events"), t["events"].select("event_id", "ts", "event_type")
    for stream in _as_stream(spark, folder, events.schema, events, events.where("event_id % 3 = 0")):
        out = SI.without_repeats(stream, late="100000 days").writeStream.format("parquet").option("path", f"{folder}/out")
        out.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    once = spark.read.parquet(f"{folder}/out")
    return once.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


@query(
    "late_queue",
    """select article_id from pushes group by 1 having sum(case tag when '推' then weight when '噓' then -weight else 0 end) >= 60""",
)
def late_queue(t, now):
    """The articles that the stream of comments leaves wanted: the first comments, a restart, then those before and after."""
    spark = t["pushes"].sparkSession
    folder = shared_folder(spark, "queue")
    weight = F.expr("case tag when '推' then weight when '噓' then -weight else 0 end")
    events = t["pushes"].select("article_id", (F.lit(1000) - F.col("seq")).alias("at"), weight.alias("weight"), "seq")
    lots = [events.where(c).drop("seq") for c in ("seq % 3 = 1", "seq % 3 <> 1")]
    with Q.ending_queries(spark):
        for k, stream in enumerate(_as_stream(spark, folder, "article_id long, at long, weight long", *lots)):
            out = Q.queue_changes(stream, threshold=60).writeStream.outputMode("update").foreachBatch(lambda b, n, k=k: b.write.mode("overwrite").parquet(f"{folder}/changes/{k}-{n}"))
            out.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema(Q.CHANGES).option("recursiveFileLookup", "true").parquet(f"{folder}/changes")
    return Q.wanted_articles(changes).select("article_id")
