"""The corpus pipeline: language ID, quality rules, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; its
result is written as Parquet and read again as the next one's docs. All stages but the last
return the columns of docs, extra ones included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import language, mixing, ngram_join, packing, quality
from pagemill.llm.common import stored


def judged(docs: DataFrame, judge: Callable[[DataFrame, dict[str, str]], DataFrame], verdict: str) -> DataFrame:
    """The rows of docs whose text passes, all columns as they were.

    Columns other than the text travel as one struct, so none can clash with the judge's own.
    """
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("text").alias("text"))
    passed = judge(packed, {"row": packed.schema["row"].dataType.simpleString(), "text": "string"}).where(verdict)
    return passed.select([F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those far from every language's centroids. Learns from the rows with a language."""
    model = language.fit(docs, F.lit(True))
    return judged(docs, lambda d, keep: language.identify(d, model, keep), "accepted")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or that the forest rejects; labels come from the tables."""
    verdicts = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs, lambda d, keep: quality.judged(d, verdicts, keep), "kept")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: that with the smallest id (null ids last, ties by a hash); rows without words are no group and stay.

    Rows are told apart by a hash of id and text, so an id that repeats with another text is
    another document. Only rows that a bitmap of the hashes that go may hold are joined with
    those, so the texts that stay aren't dealt out. Equal rows have one hash; only where there
    are any are they looked for and made one.
    """
    key = F.xxhash64(docs["doc_id"], docs["text"])
    groups = stored(ngram_join.jaccard_join(docs.select(key.alias("doc_id"), docs["text"])).where("n_shingles > 0").select(F.col("doc_id").alias("key"), "component_id"), "groups")
    named = groups.distinct().join(docs.select(key.alias("key"), docs["doc_id"].cast("long").alias("id")).distinct(), "key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).getField("key").alias("key"))
    gone = stored(named.join(first.select("key"), "key", "left_anti").select("key").distinct(), "gone")
    twice = stored(groups.groupBy("key").count().where("count > 1").select("key").join(gone, "key", "left_anti"), "twice")
    out = without(docs, key, gone)
    if not twice.limit(1).count():
        return out
    marked = twice.withColumnRenamed("key", "again")
    some = docs.select(key.alias("again"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(marked, "again").groupBy("again").agg(F.first("row").alias("row"))
    return without(out, F.xxhash64(out["doc_id"], out["text"]), twice).union(some.select([F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def without(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """docs but for rows whose key is among keys(key)."""
    maybe = ngram_join.in_bitmap(ngram_join.bitmap(keys), key)
    named = keys.select(F.col("key").alias("gone_key"))
    return docs.where(~maybe).union(docs.where(maybe).join(named, key == named["gone_key"], "left_anti"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; at a source's edge one text ends where the budget does."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A fitted classifier decides the first stage, so SQL can't give run()'s rows; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, one after another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
