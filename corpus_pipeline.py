"""Corpus pipeline: documents -> encoded training documents, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as
the docs of the next one. All but the last return the columns of documents.

1. quality classifier: documents scored below the threshold go;
2. line dedup: lines that repeat an earlier line's class go, and documents of which nothing is left; near
   copies of a document keep the lines that they share with it, else the next stage would find fragments;
3. SimHash near-dedup: one document of each group of near copies stays;
4. benchmark decontamination: documents that contain a benchmark item go;
5. SentencePiece encoding: doc_id, lang, source, ids, n_tokens and whether decoding gives the text.

Null texts count as empty and empty texts as of no quality, so they go at the first stage; rows repeated
as a whole are near copies, of which one stays; a null id is the last to stay. Empty tables of documents
or of the benchmark give empty or unchanged tables. Stages pass on whatever columns documents have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.llm import decontamination, line_dedup, near_dedup, quality_classifier, sentencepiece_codec
from forumlens.llm.queries import QUALITY_THRESHOLD, crc_mod, read
from forumlens.llm.workspace import Workspace, scratch


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weights come from the labelled rows of the whole documents table, as in the query op2."""
    weights = quality_classifier.fit(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), crc_mod(F.col("id"), 5) != 0
    )
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")  # so that no name clashes
    scored = docs.select(whole, quality_classifier.score(spark, F.col("text"), weights).alias("score"))
    kept = scored.where(F.col("score") >= QUALITY_THRESHOLD)
    return kept.select(*(F.col(f"doc.`{c}`") for c in docs.columns))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeated_lines(docs, short_lines=True, near_copies=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")  # so that no name clashes
    rows = docs.select(whole, "text")
    found = decontamination.with_matches(rows, read(spark, sf_dir, "benchmark"), "found")
    return found.where(F.size("found") == 0).select(*(F.col(f"doc.`{c}`") for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.encoded(docs)
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality classifier", keep_good_quality),
    ("line dedup", remove_repeated_lines),
    ("simhash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece encoding", encode),
]

#: classifiers, edit joins and Viterbi paths can't be written in SQL; tests hold stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's table is written to the shared folder."""
    work = Workspace(spark)
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        with scratch():
            docs = work.table(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            work.drop(f"stage-{i - 1}")
    return docs
