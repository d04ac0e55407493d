"""Schemas, keys and references of the forum tables, and the checks that stand in for constraints."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 8


@dataclass(frozen=True)
class Table:
    ddl: str
    key: tuple[str, ...]
    refers: tuple[tuple[str, str, str], ...] = ()  # (column, table, its column)

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


TABLES = {
    "boards": Table(
        "id long, name string, category_path string, title string, user_count long, latest_page_index long,"
        " last_backfill_page long, backfill_complete boolean, next_check_at long, check_interval_secs long,"
        " last_check_at long, backfill_claimed_at long, backfill_recent_complete boolean, is_hot boolean,"
        " window_floor long, created_at long, updated_at long",
        ("name",),
    ),
    "articles": Table(
        "id long, board_id long, url_id string, url_timestamp long, posted_at long, title string, author string,"
        " content string, ip string, mark string, nrec_raw string, push_count long, boo_count long, neutral_count long,"
        " net_count long, first_seen_at long, last_fetched_at long, deleted_at long",
        ("board_id", "url_id"),
        (("board_id", "boards", "id"),),
    ),
    "pushes": Table(
        "article_id long, seq long, tag string, user_id string, content string, ipdatetime string",
        ("article_id", "seq"),
        (("article_id", "articles", "id"),),
    ),
    "crawl_runs": Table(
        "id long, board_id long, run_type string, status string, pages_crawled long, articles_new long,"
        " articles_updated long, pushes_updated long, errors long, error_detail string, started_at long, finished_at long",
        ("id",),
    ),
    "backfill_meta": Table("key string, value long", ("key",)),
    "article_insights": Table(
        "article_id long, tldr string, key_points string, community_take string, top_comments string, controversy string,"
        " reply_count long, sentiment string, tags string, model string, prompt_tokens long, completion_tokens long,"
        " generated_at long, error string, schema_ver long, article_type string, entities string, ad_likelihood string,"
        " factuality string, ai_generated string, push_stance string, push_facts string, qa_summary string",
        ("article_id",),
        (("article_id", "articles", "id"),),
    ),
    "deletion_audits": Table("board_id long, url_id string, checked_at long, result string", ("board_id", "url_id")),
    "entity_refs": Table("name_norm string, name string, kind string, article_id long", ("name_norm", "article_id")),
    "entity_aliases": Table("alias string, canonical string", ("alias",)),
    "board_digests": Table(
        "board_id long, day string, digest string, article_count long, model string, prompt_tokens long,"
        " completion_tokens long, generated_at long",
        ("board_id", "day"),
    ),
}


def create_missing(spark: SparkSession, root: str) -> list[str]:
    """Writes an empty table for each that isn't there yet; returns their names. Safe to repeat."""
    made = []
    for name, table in TABLES.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            spark.createDataFrame([], table.schema).write.parquet(f"{root}/{name}")
            made.append(name)
    return made


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], t.schema) for name, t in TABLES.items()}


def duplicate_keys(name: str, df: DataFrame) -> DataFrame:
    """Keys with more than one row; empty if the table is sound."""
    return df.groupBy(*TABLES[name].key).agg(F.count("*").alias("rows")).where("rows > 1")


def orphans(name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows whose references lead nowhere, as (column, value); empty if the table is sound."""
    parts = []
    for column, other, target in TABLES[name].refers:
        ids = tables[other].select(F.col(target).alias("_target"))
        lost = tables[name].where(F.col(column).isNotNull()).join(ids, F.col(column) == F.col("_target"), "left_anti")
        parts.append(lost.select(F.lit(column).alias("column"), F.col(column).cast("string").alias("value")))
    if not parts:
        return tables[name].limit(0).select(F.lit("").alias("column"), F.lit("").alias("value"))
    return reduce(DataFrame.unionByName, parts)
