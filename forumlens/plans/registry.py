"""The registered queries and their DuckDB oracles, by name.

``@query(name, oracle)`` registers a function of (tables, now) over the adapter's tables. Oracles are
written apart from the DataFrame code, over the same views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import reads as R
from ..sources.adapter import NOW, oracle, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAY = 86400
AUTHOR, USER, ENTITY = "7", "7", "brand#12"
BUCKET = 0.05


def query(name: str, sql: str | None = None):
    def register(f: Callable[[dict, int], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(tables(spark, sf_dir), NOW)
        if sql:
            own = f"select * from ({sql})" if sql.startswith("with ") else sql  # the views' WITH comes before
            ORACLES[name] = oracle(own.replace("{now}", str(NOW)))
        return f

    return register


_LIVE = "deleted_at is null"
_TITLE = "coalesce(a.title, '(無標題)')"
_DAY = "strftime(to_timestamp({} + 28800) at time zone 'UTC', '%Y-%m-%d')"

query(
    "boards_count",
    f"""select b.id as board_id, b.name, b.user_count, count(*) as articles from articles a join boards b on b.id = a.board_id
        where {_LIVE} group by 1, 2, 3 having count(*) >= 1""",
)(lambda t, now: R.boards_count(t))

query(
    "board_by_name",
    f"""select b.id as board_id, b.name, b.title, b.user_count,
        (select count(*) from articles a where a.board_id = b.id and {_LIVE}) as articles from boards b where b.name = 'NATION_7'""",
)(lambda t, now: R.board_by_name(t, "NATION_7"))

query("hot_boards", "select id, name from boards where is_hot")(lambda t, now: R.hot_boards(t))

_CARD = f"""select a.id, a.board_id, b.name as board, a.url_id, {_TITLE} as title, a.author, a.posted_at, a.mark, a.push_count,
    a.boo_count, a.net_count, coalesce(length(a.content), 0) as content_length, i.article_id is not null as has_insight, i.tldr, i.community_take,
    i.sentiment, i.controversy,
    case when i.article_id is null then cast([] as varchar[]) when i.article_id % 8 = 0 then cast([] as varchar[])
         when i.article_id % 8 = 1 then ['a', 'b'] else ['c'] end as tags
    from articles a join boards b on b.id = a.board_id left join article_insights i on i.article_id = a.id where a.{_LIVE}"""

query("article_cards", f"select * exclude (tags), array_to_string(tags, '|') as tags from ({_CARD})")(
    lambda t, now: R.cards(t).withColumn("tags", F.array_join("tags", "|"))
)
query(
    "board_page",
    f"""select * exclude (tags), array_to_string(tags, '|') as tags,
        row_number() over (order by pinned, posted_at desc, id desc) as place
        from (select *, starts_with(title, '[公告]') as pinned from ({_CARD}) where board_id = 7 order by posted_at desc, id desc limit 30 offset 30)""",
)(lambda t, now: R.board_page(t, 7, page=2).withColumn("tags", F.array_join("tags", "|")))

_DETAIL = f"""select c.* exclude (tags), array_to_string(c.tags, '|') as tags, a.content, a.ip, i.generated_at as insight_generated_at, i.key_points,
    i.top_comments, i.model, i.article_type, i.ad_likelihood, i.factuality, i.ai_generated, i.push_facts, i.qa_summary,
    case when i.article_id % 6 = 1 then 'N' || i.article_id || ':人物|M:其他' else '' end as entities,
    case when i.article_id % 4 = 1 then cast(i.article_id % 9 as double) end as pro, case when i.article_id % 4 = 1 then cast(0 as double) end as con,
    (select coalesce(string_agg(concat(p.seq, p.tag, p.user_id, ':', p.content, p.ipdatetime), '|' order by p.seq), '') from pushes p where p.article_id = a.id) as pushes
    from ({_CARD}) c join articles a on a.id = c.id left join article_insights i on i.article_id = c.id"""


def _flat_detail(df: DataFrame) -> DataFrame:
    said = F.transform("pushes", lambda p: F.concat(p["seq"].cast("string"), p["tag"], p["user_id"], F.lit(":"), p["content"], p["ipdatetime"]))
    return df.select(
        *(c for c in df.columns if c not in ("tags", "pushes", "entities", "push_stance")), F.array_join("tags", "|").alias("tags"),
        F.array_join(F.transform("entities", lambda e: F.concat(e["name"], F.lit(":"), e["type"])), "|").alias("entities"),
        F.col("push_stance.pro").alias("pro"), F.col("push_stance.con").alias("con"), F.array_join(said, "|").alias("pushes"),
    )


query("article_detail", f"{_DETAIL} where c.id in (1, 2, 3, 4, 5, 6, 7, 25, 32, 33, 37)")(
    lambda t, now: _flat_detail(R.article_detail(t, [1, 2, 3, 4, 5, 6, 7, 25, 32, 33, 37]))
)


@query("article_by_url", f"{_DETAIL} where c.id = 37")
def article_by_url(t, now):
    """The address of an article is looked up first, as a reader would have it."""
    row = R.cards(t).where("id = 37").select("board", "url_id").first()
    return _flat_detail(R.article_by_url(t, row.board if row else "", row.url_id if row else ""))


query(
    "author_articles",
    f"""select a.id, b.name as board, a.url_id, {_TITLE} as title, a.posted_at, a.net_count, i.tldr, i.sentiment
        from articles a join boards b on b.id = a.board_id and b.is_hot
        left join article_insights i on i.article_id = a.id and i.error is null
        where a.author = '{AUTHOR}' and {_LIVE} order by a.posted_at desc, a.id desc limit 50""",
)(lambda t, now: R.author_articles(t, AUTHOR))
query(
    "author_stats",
    f"""select count(distinct a.board_id) as boards, count(*) as total, cast(coalesce(sum(a.net_count), 0) as bigint) as net_sum
        from articles a join boards b on b.id = a.board_id and b.is_hot where a.author = '{AUTHOR}' and {_LIVE}""",
)(lambda t, now: R.author_stats(t, AUTHOR))
_PUSHES = f"""from pushes p join articles a on a.id = p.article_id and a.{_LIVE} join boards b on b.id = a.board_id and b.is_hot
    where p.user_id = '{USER}'"""
query(
    "user_pushes",
    f"""select p.article_id, p.seq, p.tag, p.content, b.name as board, a.url_id, {_TITLE} as title, a.posted_at {_PUSHES}
        order by a.posted_at desc, p.article_id desc, p.seq desc limit 50""",
)(lambda t, now: R.user_pushes(t, USER))
query(
    "push_stats",
    f"""select count(*) as total, count(distinct a.board_id) as boards, count(*) filter (p.tag = '推') as pushes,
        count(*) filter (p.tag = '噓') as boos, count(*) filter (p.tag = '→') as neutrals {_PUSHES}""",
)(lambda t, now: R.push_stats(t, USER))

_DELETED = f"""select a.id, b.name as board, a.url_id, {_TITLE} as title, a.author, a.posted_at, a.deleted_at,
    left(trim(regexp_replace(coalesce(a.content, ''), '\\s+', ' ', 'g')), 300) as excerpt, i.tldr
    from articles a join boards b on b.id = a.board_id left join article_insights i on i.article_id = a.id and i.error is null
    where a.deleted_at > 0 order by a.deleted_at desc, a.id desc limit 100"""
query("deleted_articles", _DELETED)(lambda t, now: R.deleted_articles(t))
query(
    "deleted_by_day",
    f"""select {_DAY.format('deleted_at')} as day, count(*) as n, string_agg(cast(id as varchar), ',' order by deleted_at desc, id desc) as ids
        from ({_DELETED}) group by 1""",
)(lambda t, now: R.deleted_by_day(t).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ",")))

query(
    "entity_search",
    """select name_norm, name, kind, count(*) as n from entity_refs where contains(name_norm, 'brand#1')
       group by 1, 2, 3 order by n desc, name_norm, name, kind limit 30""",
)(lambda t, now: R.search_entities(t, "Brand#1"))
_ENTITY = f"""from entity_refs r join articles a on a.id = r.article_id and a.{_LIVE}
    join article_insights i on i.article_id = r.article_id and i.error is null"""
_NAMES = "r.name_norm in ('brand#12', 'brand#11', 'brand#13')"
_SIGN = "case i.sentiment when '正面' then 1 when '負面' then -1 else 0 end"
query(
    "entity_timeline",
    f"""select {_DAY.format('a.posted_at')} as day, count(*) as articles, round(sum({_SIGN}) / count(*), 9) as sentiment
        {_ENTITY} where {_NAMES} group by 1 order by 1 desc limit 60""",
)(lambda t, now: R.entity_timeline(t, ENTITY).withColumn("sentiment", F.round("sentiment", 9)))
query(
    "entity_timeline_distinct",
    f"""select {_DAY.format('posted_at')} as day, count(*) as articles, round(sum(s) / count(*), 9) as sentiment
        from (select distinct a.id, a.posted_at, {_SIGN} as s {_ENTITY} where {_NAMES}) group by 1 order by 1 desc limit 60""",
)(lambda t, now: R.entity_timeline(t, ENTITY, distinct=True).withColumn("sentiment", F.round("sentiment", 9)))
query(
    "timeline_bars",
    f"""select day, articles, total_pct, pos_pct, total_pct - pos_pct as neg_pct from (
        select *, cast(round(total_pct * (1 + sentiment) / 2) as bigint) as pos_pct from (
        select *, cast(round(100.0::double * articles / greatest(max(articles) over (), 1)) as bigint) as total_pct from (
        select {_DAY.format('a.posted_at')} as day, count(*) as articles, sum({_SIGN}) / count(*) as sentiment
        {_ENTITY} where {_NAMES} group by 1 order by 1 desc limit 60)))""",
)(lambda t, now: R.timeline_bars(R.entity_timeline(t, ENTITY)).drop("sentiment"))
query(
    "entity_articles",
    f"""select r.article_id, b.name as board, a.url_id, {_TITLE} as title, a.posted_at, a.net_count, i.tldr, i.sentiment, i.controversy
        {_ENTITY} join boards b on b.id = a.board_id where {_NAMES} order by a.posted_at desc, r.article_id desc limit 50""",
)(lambda t, now: R.entity_articles(t, ENTITY))
query("entity_count", "select count(*) as refs from entity_refs")(lambda t, now: R.entity_count(t))
query(
    "expanded_names", "select 'brand#12' as name_norm union select alias from entity_aliases where canonical = 'brand#12'"
)(lambda t, now: R.expanded_names(t, "Brand#11"))

query(
    "trending",
    f"""select *, round(100.0 * d7 / max(d7) over ()) as bar_pct, h48 * 2 + d7 as score from (
            select r.name_norm, max(r.name) as name, max(r.kind) as kind, count(distinct a.id) as d7,
            count(distinct case when a.posted_at > {{now}} - 172800 then a.id end) as h48
            {_ENTITY} where a.posted_at > {{now}} - 604800 group by 1 having count(distinct a.id) >= 3
            order by h48 * 2 + d7 desc, d7 desc, r.name_norm limit 30)""",
)(lambda t, now: R.trending(t, now))
_RISING = f"""select a.id, b.name as board, a.url_id, a.title, a.posted_at, a.push_count, a.boo_count, a.net_count,
    case when {{now}} - a.posted_at > 0 then a.push_count * 3600.0::double / ({{now}} - a.posted_at) else a.push_count::double end as vph
    from articles a join boards b on b.id = a.board_id
    where a.{_LIVE} and a.posted_at > {{now}} - 48 * 3600 and a.push_count > 5
    order by a.push_count * 3600.0::double / greatest({{now}} - a.posted_at, 1800) desc, a.id desc limit 30"""
query("rising", f"select * exclude (vph), round(vph, 9) as vph from ({_RISING})")(
    lambda t, now: R.rising(t, now, 48).withColumn("vph", F.round("vph", 9))
)
_CALIBRATION = f"""select floor(push_count * 3600.0::double / greatest({{now}} - posted_at, 3600) / {BUCKET}::double) * {BUCKET}::double as bucket_vph,
    count(*) as n, (count(*) filter (net_count >= 90) + 1)::double / (count(*) + 2) as p_hot from articles
    where {_LIVE} and posted_at between {{now}} - 2592000 and {{now}} - 172800 and push_count > 5 group by 1 having count(*) >= 3"""
query("calibration", f"select round(bucket_vph, 9) as bucket_vph, n, round(p_hot, 9) as p_hot from ({_CALIBRATION})")(
    lambda t, now: R.calibration(t, now, BUCKET).select(F.round("bucket_vph", 9).alias("bucket_vph"), "n", F.round("p_hot", 9).alias("p_hot"))
)
query(
    "rising_with_probability",
    f"""select r.* exclude (vph), round(r.vph, 9) as vph, round(coalesce(
        (select arg_max(c.p_hot, c.bucket_vph) from ({_CALIBRATION}) c where c.bucket_vph <= r.vph),
        (select arg_min(c.p_hot, c.bucket_vph) from ({_CALIBRATION}) c), 0), 9) as p_hot from ({_RISING}) r""",
)(lambda t, now: R.rising_with_probability(t, now, 48, BUCKET).withColumn("vph", F.round("vph", 9)).withColumn("p_hot", F.round("p_hot", 9)))

_SINCE = NOW - 30 * DAY
_CANDIDATES = f"""select *, count(*) over (partition by board_id) as candidates from (
    select a.board_id, b.name as board, row_number() over (partition by a.board_id order by a.net_count desc nulls last, a.id desc) as place,
    a.id, {_TITLE} as title, a.net_count, i.tldr, i.sentiment
    from articles a join boards b on b.id = a.board_id
    join article_insights i on i.article_id = a.id and i.error is null and i.generated_at > {_SINCE} where a.{_LIVE}) where place <= 15"""
query("digest_candidates", f"select * exclude (candidates) from ({_CANDIDATES})")(lambda t, now: R.digest_candidates(t, _SINCE))
query(
    "digest_prompts",
    f"""select board_id, board, count(*) as article_count, '看板：' || board || chr(10) ||
        string_agg('- ' || title || '（' || cast(net_count as varchar) || '）：' || coalesce(tldr, ''), chr(10) order by place) as prompt
        from ({_CANDIDATES}) where candidates >= 3 group by 1, 2""",
)(lambda t, now: R.digest_prompts(t, _SINCE))
query(
    "latest_digests",
    """select b.id as board_id, b.name, d.day, d.digest, d.article_count from boards b left join
       (select *, row_number() over (partition by board_id order by day desc) as n from board_digests) d on d.board_id = b.id and d.n = 1
       where b.is_hot""",
)(lambda t, now: R.latest_digests(t))
query(
    "boards_without_digest",
    "select id, name from boards b where is_hot and not exists (select 1 from board_digests d where d.board_id = b.id and d.day = '2001-08-02')",
)(lambda t, now: R.boards_without_digest(t, "2001-08-02"))

_QUEUE = "select a.id, a.board_id, a.title, a.author, a.content, a.net_count, a.posted_at from articles a"
_WORTH = "length(a.content) > 20 and coalesce(a.net_count, 0) >= 20"
_PENDING = f"""{_QUEUE} left join article_insights i on i.article_id = a.id where a.{_LIVE} and {_WORTH}
    and (i.article_id is null or (i.error <> 'content_filter' and i.generated_at < {{now}} - 3600) or (i.error is null and i.schema_ver < 2))
    order by a.net_count desc, a.posted_at desc, a.id desc limit 50"""
_STALE = f"""{_QUEUE} join article_insights i on i.article_id = a.id where a.{_LIVE} and {_WORTH} and i.error is null
    and a.posted_at > {NOW - 90 * DAY} and a.last_fetched_at > i.generated_at and i.generated_at < {{now}} - 3600
    order by a.posted_at desc, a.id desc limit 50"""
query("pending_articles", _PENDING)(lambda t, now: R.pending_articles(t, now))
query(
    "pending_articles_gated",
    _PENDING.replace("and (i.article_id is null or", "and a.posted_at < {now} - 604800 and (i.article_id is null or"),
)(lambda t, now: R.pending_articles(t, now, min_age=7 * DAY))
query("stale_articles", _STALE)(lambda t, now: R.stale_articles(t, now, NOW - 90 * DAY))
query(
    "filtered_articles",
    f"""{_QUEUE} join article_insights i on i.article_id = a.id where i.error = 'content_filter'
        order by a.net_count desc, a.id desc limit 50""",
)(lambda t, now: R.filtered_articles(t, now))
query(
    "insight_queue",
    f"""select q.*, coalesce((select string_agg(p.tag || p.user_id, '|' order by p.seq) from pushes p where p.article_id = q.id), '') as pushes
        from (select *, false as stale from ({_PENDING}) union all select *, true from ({_STALE})) q""",
)(
    lambda t, now: R.insight_queue(t, now, NOW - 90 * DAY).withColumn(
        "pushes", F.coalesce(F.array_join(F.transform("pushes", lambda p: F.concat(p["tag"], p["user_id"])), "|"), F.lit(""))
    )
)
query(
    "insight_states",
    f"""select case when i.article_id is null then 'pending' when i.error = 'content_filter' then 'filtered'
        when i.error is not null then case when i.generated_at < {{now}} - 3600 then 'pending' else 'cooling' end
        when i.schema_ver < 2 then 'outdated' else 'done' end as state, count(*) as articles
        from articles a left join article_insights i on i.article_id = a.id where a.{_LIVE} group by 1""",
)(lambda t, now: R.state_counts(t, now))
query(
    "due_boards",
    "select id, name, next_check_at, check_interval_secs from boards where is_hot and next_check_at <= {now} order by next_check_at, id limit 10",
)(lambda t, now: R.due_boards(t, now, 10))
_BOTTOM = NOW - 20 * 864000
query(
    "backfill_boards",
    f"""select id, name, user_count, last_backfill_page from boards where not backfill_complete and is_hot
        and (backfill_claimed_at is null or backfill_claimed_at < {{now}} - 21600) and (window_floor is null or window_floor > {_BOTTOM})
        order by last_backfill_page > 1, user_count desc, id limit 5""",
)(lambda t, now: R.backfill_boards(t, now, _BOTTOM, 5))
query(
    "unaudited_deletions",
    """select id, board_id, url_id, deleted_at from articles a where deleted_at between {now} - 315360000 and {now} - 86400
       and not exists (select 1 from deletion_audits d where d.board_id = a.board_id and d.url_id = a.url_id)
       order by deleted_at desc, id desc limit 50""",
)(lambda t, now: R.unaudited_deletions(t, now, max_age=3650 * DAY))

_STATS = f"""select (select count(*) from article_insights where error is null) as analyzed,
    (select count(*) from articles a where a.{_LIVE} and {_WORTH} and (posted_at is null or posted_at < {{now}})) as total"""
query("insight_stats", _STATS)(lambda t, now: R.insight_stats(t, now))
query("health", "select '{\"status\":\"ok\",\"analyzed\":' || analyzed || ',\"total\":' || total || '}' as body from (" + _STATS + ")")(
    lambda t, now: R.health(t, now)
)
_CREDITS = "coalesce(round(sum(prompt_tokens * 6.9::double + completion_tokens * 24.0::double) / 10000.0::double * 0.5::double), 0)"
_WAITING = f"""from articles a left join article_insights i on i.article_id = a.id where a.{_LIVE} and a.net_count between 20 and 999999
    and (i.article_id is null or i.schema_ver = 1)"""
_STATUS = f"""select (select count(*) from article_insights where error is null and schema_ver = 2) as v2_total,
    (select count(*) from article_insights where error is null and schema_ver = 1) as v1_remaining,
    (select count(*) from article_insights where error is not null and generated_at > {{now}} - 3600) as error_cooldown,
    (select count(*) from article_insights where error is null and generated_at > {{now}} - 3600) as last_1h,
    (select count(*) from article_insights where error is null and generated_at > {{now}} - 86400) as last_24h,
    (select {_CREDITS} from article_insights where error is null and generated_at > {{now}} - 86400) as credits_24h,
    (select {_CREDITS} from article_insights where error is null and generated_at > {{now}} - 604800) as credits_7d,
    (select count(*) {_WAITING} and (a.posted_at is null or a.posted_at < {{now}} - 604800)) as pending_eligible,
    (select count(*) {_WAITING} and a.posted_at between {{now}} - 604800 and {{now}} + 86400) as pending_gated,
    (select count(*) from board_digests where day = {_DAY.format('{now}')}) as digests_today"""
query(
    "status",
    f"""select *, round(100.0 * credits_7d / 140000::double, 1) as budget_pct,
        case when last_24h > 0 then cast(ceil(pending_eligible::double / last_24h) as bigint) end as drain_days from ({_STATUS})""",
)(lambda t, now: R.status(t, now))
query(
    "table_counts",
    """select (select count(*) from boards) as boards, (select count(*) from articles) as articles,
       (select count(*) from pushes) as pushes, (select count(*) from article_insights) as article_insights""",
)(lambda t, now: R.table_counts(t))
query(
    "audit_counters",
    """select count(*) as checked, count(*) filter (result = 'alive') as resurrected, count(*) filter (result = 'gone') as gone,
       count(*) filter (result = 'alive') >= 10 as alarm from deletion_audits""",
)(lambda t, now: R.audit_counters(t))


@query(
    "display_columns",
    f"""select a.id, case when month(d) < 10 then ' ' else '' end || month(d) || '/' || day(d) as list_date,
        strftime(d, '%a %b ') || lpad(cast(day(d) as varchar), 2, ' ') || strftime(d, ' %H:%M:%S %Y') as article_time,
        case when {{now}} - posted_at < 60 then '剛剛' when {{now}} - posted_at < 3600 then cast(({{now}} - posted_at) // 60 as varchar) || ' 分鐘前'
             when {{now}} - posted_at < 86400 then cast(({{now}} - posted_at) // 3600 as varchar) || ' 小時前'
             when {{now}} - posted_at < 172800 then '昨天'
             when {{now}} - posted_at < 604800 then cast(({{now}} - posted_at) // 86400 as varchar) || ' 天前'
             else strftime(d, '%m/%d') end as relative_time,
        isodow(d) <= 5 and hour(d) between 14 and 17 as peak,
        case i.sentiment when '正面' then 'c-f2' when '負面' then 'c-f1' else 'c-white' end as sentiment_class,
        case i.controversy when '高' then 'c-f1' when '中' then 'c-f3' else 'c-white' end as controversy_class,
        cast(split_part(a.url_id, '.', 2) as bigint) as url_time, '/bbs/' || b.name || '/' || a.url_id || '.html' as url
        from (select *, to_timestamp(posted_at + 28800) at time zone 'UTC' as d from articles) a join boards b on b.id = a.board_id
        left join article_insights i on i.article_id = a.id where a.{_LIVE}""",
)
def display_columns(t, now):
    rows = R.live(t).join(R._boards(t), "board_id")
    own = t["article_insights"].select(F.col("article_id").alias("id"), "sentiment", "controversy")
    at = F.col("posted_at")
    return rows.join(own, "id", "left").select(
        "id",
        X.list_date(at).alias("list_date"),
        X.article_time(at).alias("article_time"),
        X.relative_time(at, now).alias("relative_time"),
        X.is_peak(at).alias("peak"),
        X.sentiment_class(F.col("sentiment")).alias("sentiment_class"),
        X.controversy_class(F.col("controversy")).alias("controversy_class"),
        X.url_id_time(F.col("url_id")).alias("url_time"),
        X.article_url(F.col("board"), F.col("url_id")).alias("url"),
    )


@query(
    "board_pages",
    f"""select b.name, greatest(1, cast(ceil(count(a.id) / 30.0) as bigint)) as pages,
        '/bbs/' || b.name || '/index' || greatest(1, greatest(1, cast(ceil(count(a.id) / 30.0) as bigint)) - 1) || '.html' as second
        from boards b left join articles a on a.board_id = b.id and a.{_LIVE} group by 1""",
)
def board_pages(t, now):
    counts = R.live(t).groupBy("board_id").agg(F.count("*").alias("n"))
    rows = t["boards"].join(counts, F.col("id") == F.col("board_id"), "left")
    pages = X.total_pages(F.coalesce("n", F.lit(0)), 30)
    return rows.select("name", pages.alias("pages"), X.board_page_href(F.col("name"), pages, F.lit(2)).alias("second"))


# writes: a transition of the adapter's tables, its result against the same rule in SQL

_ARTICLES = "id, board_id, url_id, posted_at, title, net_count, deleted_at"


def _with_schema(t, name):
    """The adapter's rows with every column of the stored table."""
    from ..schemas import TABLES

    df = t[name]
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name].schema))


@query(
    "upsert_articles",
    f"""select id, board_id, url_id, posted_at, case when id % 50 = 1 then 'edited' else title end as title,
        case when id % 50 = 1 then net_count + 1 else net_count end as net_count,
        case when id % 50 = 1 then null else deleted_at end as deleted_at,
        case when id % 50 = 1 then {{now}} else last_fetched_at end as last_fetched_at from articles
        union all select (select max(id) from articles) + id, id, 'M.1.A.NEW', null, 'new', 0, null, {{now}} from boards""",
)
def upsert_articles(t, now):
    from ..operators import state as S

    changed = t["articles"].where("id % 50 = 1").select("board_id", "url_id", F.lit("edited").alias("title"), (F.col("net_count") + 1).alias("net_count"))
    new = t["boards"].select(F.col("id").alias("board_id"), F.lit("M.1.A.NEW").alias("url_id"), F.lit("new").alias("title"), F.lit(0).alias("net_count"))
    out = S.upsert_articles(_with_schema(t, "articles"), changed.unionByName(new), now)
    # ids of new rows follow their key; equal url_ids are ordered here by their board
    top = t["articles"].agg(F.max("id").alias("top"))
    rows = out.select("id", "board_id", "url_id", "posted_at", "title", "net_count", "deleted_at", "last_fetched_at").join(F.broadcast(top))
    return rows.withColumn("id", F.when(F.col("url_id") == "M.1.A.NEW", F.col("top") + F.col("board_id")).otherwise(F.col("id"))).drop("top")


@query(
    "replace_pushes",
    """select article_id, seq, tag, user_id, content from pushes where article_id % 7 <> 0
       union all select distinct article_id, 0, '推', 'me', 'again' from pushes where article_id % 7 = 0""",
)
def replace_pushes(t, now):
    from ..operators import state as S

    touched = t["pushes"].where("article_id % 7 = 0").select("article_id").distinct()
    fresh = touched.select("article_id", F.lit(0).cast("long").alias("seq"), F.lit("推").alias("tag"), F.lit("me").alias("user_id"), F.lit("again").alias("content"))
    return S.replace_pushes(t["pushes"].drop("weight", "ipdatetime"), fresh, touched)


@query(
    "mark_deleted",
    """select id, case when deleted_at is null and id % 9 = 0 then {now} else deleted_at end as deleted_at from articles""",
)
def mark_deleted(t, now):
    from ..operators import state as S

    return S.mark_deleted(t["articles"], t["articles"].where("id % 9 = 0"), now).select("id", "deleted_at")


@query("resurrect", "select id, case when id % 20 <> 0 then deleted_at end as deleted_at from articles")
def resurrect(t, now):
    from ..operators import state as S

    return S.resurrect(t["articles"], t["articles"].where("id % 20 = 0")).select("id", "deleted_at")


@query(
    "insight_errors",
    """select article_id, tldr, case when article_id % 4 = 0 then 'llm status 500' else error end as error,
       case when article_id % 4 = 0 then {now} else generated_at end as generated_at, schema_ver from article_insights
       union all select id, '(分析失敗)', 'llm status 500', {now}, 1 from articles where id % 4 = 0 and id % 3 = 0""",
)
def insight_errors(t, now):
    from ..operators import state as S

    errors = t["articles"].where("id % 4 = 0").select(F.col("id").alias("article_id"), F.lit("llm status 500").alias("error"))
    out = S.mark_insight_errors(_with_schema(t, "article_insights"), errors, now)
    return out.select("article_id", "tldr", "error", "generated_at", "schema_ver")


@query(
    "release_claims",
    "select id, cast(null as bigint) as backfill_claimed_at, (select count(*) from boards where backfill_claimed_at is not null) as released from boards",
)
def release_claims(t, now):
    from ..operators import state as S

    boards, released = S.release_claims(_with_schema(t, "boards"), now)
    return boards.select("id", "backfill_claimed_at").join(F.broadcast(released))


# ingest: the adapter's articles as a page listing

_LISTED = """(select board_id, url_id, posted_at as url_timestamp, id % 13 = 5 as deleted, case when id % 6 = 0 then '!' else '' end as mark,
    case when id % 4 = 0 then '9' else '' end as nrec_raw from articles where id % 3 <> 1)"""


def _listing(t):
    rows = t["articles"].where("id % 3 <> 1")
    return rows.select(
        "board_id", "url_id", F.col("posted_at").alias("url_timestamp"), F.expr("id % 13 = 5").alias("deleted"), F.lit(1).alias("page"),
        F.expr("if(id % 6 = 0, '!', '')").alias("mark"), F.expr("if(id % 4 = 0, '9', '')").alias("nrec_raw"),
    )


@query(
    "listing_bounds",
    f"""select board_id, coalesce(min(url_timestamp) filter (not deleted and mark <> '!'), 0) as oldest,
        coalesce(max(url_timestamp) filter (not deleted and url_id <> ''), 0) as newest from {_LISTED} l group by 1""",
)
def listing_bounds(t, now):
    from ..operators import ingest as I

    return I.oldest_time(_listing(t)).join(I.newest_time(_listing(t)), "board_id")


@query(
    "entry_actions",
    f"""select l.board_id, l.url_id, false as insert, a.deleted_at is not null as resurrect, l.nrec_raw <> '' as refetch,
        l.nrec_raw <> '' or a.mark is distinct from nullif(l.mark, '') as update_meta
        from {_LISTED} l join articles a on a.board_id = l.board_id and a.url_id = l.url_id where not l.deleted and a.id % 8 <> 0
        union all select l.board_id, l.url_id, true, false, false, false
        from {_LISTED} l join articles a on a.board_id = l.board_id and a.url_id = l.url_id where not l.deleted and a.id % 8 = 0""",
)
def entry_actions(t, now):
    from ..operators import ingest as I

    known = t["articles"].where("id % 8 <> 0").withColumn("nrec_raw", F.lit(None).cast("string"))
    return I.entry_actions(_listing(t), known).drop("article_id", "nrec_raw", "mark")


@query(
    "vanished_candidates",
    f"""select a.board_id, a.url_id, a.url_timestamp from articles a
        join (select board_id, min(url_timestamp) as oldest from {_LISTED} l where not deleted group by 1) o
        on o.board_id = a.board_id and a.url_timestamp > o.oldest where a.{_LIVE} and not exists
        (select 1 from {_LISTED} l where l.board_id = a.board_id and l.url_id = a.url_id and not l.deleted)""",
)
def vanished_candidates(t, now):
    from ..operators import ingest as I

    return I.vanished_candidates(t["articles"], _listing(t))


@query(
    "daily_counts",
    """select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2""",
)
def daily_counts(t, now):
    from ..streaming import ingest as SI

    return SI.daily_counts(t["events"]).withColumn("value", F.round("value", 4))


@query(
    "event_entities",
    """select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n, count(distinct user_id) as users from events group by 1""",
)
def event_entities(t, now):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return t["events"].groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    "document_excerpts",
    """select doc_id, left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 300) as excerpt, length(text) as length,
       '標題：' || lang || chr(10) || chr(10) || '--- 文章內容 ---' || chr(10) ||
       case when length(text) > 3000 then left(text, 3000) || chr(10) || '...(內容過長已截斷)' else text end || chr(10) || chr(10) || '--- 推文：（無）---' as prompt
       from documents""",
)
def document_excerpts(t, now):
    from ..functions import analysis as A

    none = F.array().cast("array<struct<seq:bigint,tag:string,user_id:string,content:string>>")
    return t["documents"].select(
        "doc_id", X.excerpt(F.col("text")).alias("excerpt"), F.length("text").cast("long").alias("length"),
        A.prompt(F.col("lang"), F.lit(None).cast("string"), F.col("text"), none).alias("prompt"),
    )


@query(
    "conversation_turns",
    """select conv_id, count(*) as turns, string_agg(role || ':' || length(text), '|' order by turn, role, text) as outline
       from conversations group by 1""",
)
def conversation_turns(t, now):
    rows = t["conversations"].groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("r"))
    line = F.transform("r", lambda x: F.concat(x["role"], F.lit(":"), F.length(x["text"]).cast("string")))
    return rows.select("conv_id", F.size("r").cast("long").alias("turns"), F.array_join(line, "|").alias("outline"))


@query("page_contents")
def page_contents(t, now):
    from ..functions import html as H

    return t["pages"].select("page_id", H.parse_web_page(F.col("html")).alias("p")).select(
        "page_id", "p.title", F.size("p.links").cast("long").alias("n_links"), F.length("p.text").cast("long").alias("n_chars")
    )


from . import transitions  # noqa: E402,F401  (registers its queries)
