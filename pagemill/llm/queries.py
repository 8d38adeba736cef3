"""The opN_<name> queries: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, language, licenses, lm_scoring, mixing, ngram_join, packing, quality, tokens, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents by 5-word shingles: set sizes, numbers of links, components."""
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts by a model that learns from six folds of seven."""
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and detections of all texts."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors by cosine."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all texts, learnt from three folds of four."""
    return language.language_rows(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of all texts, and a verdict calibrated from labels."""
    return quality.quality_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    pages = table(spark, sf_dir, "pages")
    archive = warc.write_archives(warc.plan_records(pages))
    records = warc.read_archives(spark, archive)
    return records.select(
        F.col("record_id").cast("long").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all texts."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts packed into sequences of 2048 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources mixed to target weights."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ngram_jaccard_join, op2_lm_scoring, op3_license_scan, op4_embedding_dedup, op5_language_id, op6_quality_rules, op7_warc_roundtrip, op8_token_counts, op9_harmonic_packing, op10_source_mixing)
}
