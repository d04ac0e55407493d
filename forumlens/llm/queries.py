"""The registered queries opN_<name>: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination,
    fertility,
    language_id,
    license_scan,
    line_dedup,
    oracles,
    pii,
    quality_classifier,
    sentencepiece_codec,
    simhash,
    spelling,
    substring_dedup,
    toxicity,
    vector_codes,
)
from .workspace import Workspace


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.simhash_classes(read(spark, sf_dir, "documents"))
    return classes.select(
        F.col("id").alias("doc_id"),
        simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"),
        F.col("class_id").alias("component_id"),
    )


def crc_mod(doc_id: F.Column, parts: int) -> F.Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def _scored(docs: DataFrame, score: F.Column, threshold: float) -> DataFrame:
    return docs.select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


QUALITY_THRESHOLD = 0.3
TOXIC_THRESHOLD = 0.5


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    weights = quality_classifier.fit(docs, read(spark, sf_dir, "labels"), crc_mod(F.col("id"), 5) != 0)
    return _scored(docs, quality_classifier.score(spark, F.col("text"), weights), QUALITY_THRESHOLD)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    # texts are measured once, for the bands and for the verdicts
    measured = Workspace(spark).table(fertility.measures(docs), "measures")
    bands = fertility.fit_measured(measured, fertility.good_ids(read(spark, sf_dir, "labels"), crc_mod(F.col("id"), 5) != 0))
    return fertility.judged(measured, bands).withColumnRenamed("id", "doc_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    weights = toxicity.fit(docs, read(spark, sf_dir, "labels"), crc_mod(F.col("id"), 5) != 0)
    return _scored(docs, toxicity.score(spark, F.col("text"), weights), TOXIC_THRESHOLD)


def pii_digest(docs: DataFrame) -> DataFrame:
    def joined(spans: str) -> str:
        return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"

    base = [k.name for k in pii.KINDS if k.base]
    return pii.find_pii(docs).selectExpr(
        "id as doc_id",
        *(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint) as n_{k}" for k in base),
        f"sha2({joined(f'filter(spans, s -> s.rank < {len(base)})')}, 256) as base_sha256",
        f"{joined('spans')} as spans",
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, its lines that take part, how many repeat or are linked, and each line's class and links."""
    return line_dedup.LineClasses(read(spark, sf_dir, "documents"), short_lines=True).by_document().withColumnRenamed("id", "doc_id")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the whole text, how many they are, and whether decoding gives the text back.

    A null text has null ids, a null number of them, and counts as given back; an empty text has no ids; repeated rows
    and null ids have rows of their own. An empty table gives an empty result."""
    coded = sentencepiece_codec.encoded(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    filters = language_id.fit(docs, crc_mod(F.col("id"), 4) != 2)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    found = docs.select("doc_id", held_out.alias("held_out"), language_id.predict(spark, F.col("text"), filters).alias("m"))
    return found.select("doc_id", "held_out", "m.*")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, whether it contains a benchmark item, the best covered item and all items found.

    Null and empty texts contain nothing; of equally covered items the smallest id is the best one; an empty benchmark or
    table gives no item or no row; repeated rows and null ids have rows of their own."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.with_matches(docs, read(spark, sf_dir, "benchmark"), "found")
    best = F.array_sort(F.transform("found", lambda m: F.struct((-m["coverage"]).alias("c"), m["item_id"].alias("i"))))
    return found.select(
        "doc_id",
        (F.size("found") > 0).alias("contaminated"),
        F.get(best, 0)["i"].alias("item_id"),
        F.coalesce(-F.get(best, 0)["c"], F.lit(0.0)).alias("coverage"),
        F.array_sort(F.col("found.item_id")).alias("item_ids"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, its code, its error, the error of its label, and a digest of the codebooks."""
    return vector_codes.vector_codes(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, its words, how many of them repeat smaller documents, and a digest of the others."""
    return substring_dedup.substring_dedup(read(spark, sf_dir, "documents")).drop("kept").withColumnRenamed("id", "doc_id")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of the damaged texts with its form, its root and its near words."""
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_line_dedup": op6_line_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_license_scan": op8_license_scan,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_vector_codes": op11_vector_codes,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES: dict[str, str] = oracles.ORACLES
