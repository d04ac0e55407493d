"""Forum tables derived from the supplied Parquet tables.

Orders are articles, line items are pushes, customers are authors, nations are boards and part brands
are entities. The definitions are plain SQL, given to Spark as views and to the oracle as CTEs; the
only difference is how an epoch is taken from a timestamp.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: the pinned "now" of the registered queries: 2001-08-02 00:00 UTC
NOW = 996710400

_EPOCH = {"spark": "unix_seconds(cast({} as timestamp))", "duckdb": "cast(floor(epoch({})) as bigint)"}

_VIEWS = {
    "boards": """
        select cast(n_nationkey as bigint) as id, n_name as name, cast(null as varchar(99)) as category_path,
               'board of ' || n_name as title, cast((n_nationkey * 37) % 100 as bigint) as user_count,
               cast(n_nationkey + 3 as bigint) as latest_page_index, cast(1 + n_nationkey % 3 as bigint) as last_backfill_page,
               n_nationkey % 5 = 0 as backfill_complete, cast({now} + (n_nationkey % 7 - 3) * 600 as bigint) as next_check_at,
               cast(600 as bigint) as check_interval_secs,
               case when n_nationkey % 4 = 0 then cast({now} - n_nationkey * 3600 as bigint) end as backfill_claimed_at,
               n_regionkey <> 4 as is_hot,
               case when n_nationkey % 6 <> 0 then cast({now} - n_nationkey * 864000 as bigint) end as window_floor
        from nation""",
    "push_rows": """
        select l_orderkey as article_id, l_partkey as part_id,
               cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate,
                    l_quantity, l_extendedprice) - 1 as bigint) as seq,
               case l_returnflag when 'A' then '推' when 'R' then '噓' else '→' end as tag,
               cast(l_suppkey as varchar(20)) as user_id, 'line ' || cast(l_linenumber as varchar(9)) as content,
               cast(l_quantity as bigint) as weight, '07/' || cast(l_linenumber as varchar(9)) as ipdatetime
        from lineitem""",
    "push_sums": """
        select l_orderkey as article_id,
               cast(sum(case when l_returnflag = 'A' then cast(l_quantity as bigint) else 0 end) as bigint) as push_count,
               cast(sum(case when l_returnflag = 'R' then cast(l_quantity as bigint) else 0 end) as bigint) as boo_count,
               cast(sum(case when l_returnflag not in ('A', 'R') then cast(l_quantity as bigint) else 0 end) as bigint) as neutral_count
        from lineitem group by l_orderkey""",
    "article_base": """
        select o_orderkey as id, cast(c_nationkey as bigint) as board_id, cast(o_custkey as varchar(20)) as author,
               {epoch} as day_at, {epoch} + (o_orderkey * 7919) % 86400 as posted_at,
               o_orderstatus as status, o_orderpriority as priority
        from orders join customer on o_custkey = c_custkey""",
    "articles": """
        select b.id, b.board_id, 'M.' || cast(posted_at as varchar(20)) || '.A.' || cast(b.id as varchar(20)) as url_id,
               posted_at as url_timestamp, posted_at,
               case when b.id % 13 = 0 then null when b.id % 17 = 0 then '[公告] notice ' || cast(b.id as varchar(20))
                    else 'topic ' || cast(b.id as varchar(20)) end as title,
               author,
               case when b.id % 7 = 0 then null when b.id % 9 = 0 then 'short'
                    else 'post ' || cast(b.id as varchar(20)) || ' about   ' || priority end as content,
               case when b.id % 3 = 0 then 'M' end as mark, case when b.id % 4 <> 0 then '10.0.0.' || cast(b.id % 250 as varchar(9)) end as ip,
               coalesce(push_count, 0) as push_count, coalesce(boo_count, 0) as boo_count,
               coalesce(neutral_count, 0) as neutral_count,
               coalesce(push_count, 0) - coalesce(boo_count, 0) as net_count,
               posted_at as first_seen_at, posted_at + (b.id % 72) * 3600 as last_fetched_at,
               case when status = 'F' and b.id % 10 = 0 then day_at + 172800 end as deleted_at
        from article_base b left join push_sums p on p.article_id = b.id""",
    "article_insights": """
        select id as article_id, 'summary ' || cast(id as varchar(20)) as tldr,
               case id % 4 when 0 then '正面' when 1 then '負面' when 2 then '中立' end as sentiment,
               case id % 3 when 1 then '高' else '低' end as controversy,
               case when id % 8 = 0 then 'not json' when id % 8 = 1 then '["a", 1, "b"]' else '["c"]' end as tags,
               case when id % 11 = 0 then case when id % 2 = 0 then 'content_filter' else 'llm status 429' end end as error,
               cast(case when id % 5 = 0 then 1 else 2 end as bigint) as schema_ver,
               posted_at + (id % 48) * 3600 as generated_at,
               cast(100 + id % 900 as bigint) as prompt_tokens, cast(10 + id % 90 as bigint) as completion_tokens,
               case when id % 5 <> 0 then 'take ' || cast(id as varchar(20)) end as community_take,
               case when id % 5 <> 0 then '["point ' || cast(id as varchar(20)) || '"]' end as key_points,
               case when id % 7 = 2 then '["best"]' end as top_comments, 'model-' || cast(id % 3 as varchar(9)) as model,
               case when id % 4 = 0 then '閒聊' else '問題' end as article_type,
               case id % 6 when 1 then '[' || chr(123) || '"name":"N' || cast(id as varchar(20)) || '","type":"人物"' || chr(125) || ',' || chr(123)
                    || '"x":1' || chr(125) || ',' || chr(123) || '"name":"M"' || chr(125) || ']' when 5 then 'not json' end as entities,
               case when id % 2 = 0 then '低' else '高' end as ad_likelihood, '觀點' as factuality,
               case when id % 9 = 1 then '疑似AI' else '不確定' end as ai_generated,
               case id % 4 when 1 then chr(123) || '"pro":' || cast(id % 9 as varchar(9)) || ',"con":"x"' || chr(125) when 3 then '[1]' end as push_stance,
               case when id % 3 = 1 then 'fact ' || cast(id as varchar(20)) end as push_facts, 'answer ' || cast(id as varchar(20)) as qa_summary
        from articles where id % 3 <> 0""",
    "entity_refs": """
        select distinct lower(p_brand) as name_norm, p_brand as name, '產品' as kind, r.article_id
        from push_rows r join part on r.part_id = p_partkey join article_insights i on i.article_id = r.article_id""",
    "entity_aliases": """
        select * from (values ('brand#1', 'brand#2'), ('brand#11', 'brand#12'), ('brand#13', 'brand#12')) v(alias, canonical)""",
    "deletion_audits": """
        select board_id, url_id, deleted_at + 90000 as checked_at, case when id % 3 = 0 then 'alive' else 'gone' end as result
        from articles where deleted_at is not null and id % 20 = 0""",
    "board_digests": """
        select b.id as board_id, d.day, 'digest of ' || b.name as digest, cast(5 as bigint) as article_count
        from boards b join (values ('2001-08-01', 2), ('2001-08-02', 3)) d(day, every) on b.id % d.every = 0""",
}

#: bytes of the file of pushes for each partition of entity_refs
PART_BYTES = 2 << 20

_INPUTS = ("region", "nation", "supplier", "lineitem", "orders", "customer", "part", "documents", "conversations", "events", "pages")


def _text(name: str, engine: str, now: int) -> str:
    sql = _VIEWS[name].format(now=now, epoch=_EPOCH[engine].format("o_orderdate"))
    return sql.replace("varchar(99)", "string").replace("varchar(20)", "string").replace("varchar(9)", "string") if engine == "spark" else sql


class Tables(dict):
    """The forum tables and the supplied ones they come from, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, now: int = NOW):
        super().__init__()
        self.spark, self.sf_dir, self.now = spark, sf_dir, now

    def __missing__(self, name: str) -> DataFrame:
        if name == "pushes":
            df = self["push_rows"].drop("part_id")
        elif name == "entity_refs":
            df = self._entity_refs()
        elif name in _VIEWS:
            sql = _text(name, "spark", self.now)
            used = [t for t in (*_INPUTS, *_VIEWS) if t != name and re.search(rf"\b(?:from|join)\s+{t}\b", sql)]
            for t in used:
                sql = _bind(sql, t)
            # named arguments bind DataFrames without registering views
            df = self.spark.sql(sql, **{t: self[t] for t in used})
        elif name in _INPUTS:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        else:
            raise KeyError(name)
        self[name] = df
        return df

    def _entity_refs(self) -> DataFrame:
        """The view's rows, joined and made distinct in as many partitions as the pushes have ``PART_BYTES`` of input: partitions
        that Spark merges by their compressed shuffle bytes hold millions of these short rows, one hash entry each."""
        parts = max(1, -(-int(str(self["lineitem"]._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // PART_BYTES))
        part = self["part"].select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("name"))
        named = self["push_rows"].select("article_id", "part_id").join(part, "part_id").select("article_id", "name").repartition(parts, "article_id")
        known = self["article_insights"].select("article_id").repartition(parts, "article_id")
        each = named.join(known, "article_id").select("name", "article_id").distinct()
        return each.select(F.lower("name").alias("name_norm"), "name", F.lit("產品").alias("kind"), "article_id")


def tables(spark: SparkSession, sf_dir: str, now: int = NOW) -> Tables:
    return Tables(spark, sf_dir, now)


def _bind(sql: str, table: str) -> str:
    return re.sub(rf"\b(from|join)(\s+){table}\b", rf"\1\2{{{table}}}", sql)


def oracle(sql: str, now: int = NOW) -> str:
    """A DuckDB query over the same views."""
    views = ",\n".join(f"{name} as ({_text(name, 'duckdb', now)})" for name in _VIEWS)
    return f"with {views},\npushes as (select article_id, seq, tag, user_id, content, weight, ipdatetime from push_rows)\n{sql}"
