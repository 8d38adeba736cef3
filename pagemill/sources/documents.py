"""Sources and sinks of HTML documents: (doc_id, html) frames, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a partition should hold; one small Parquet file would otherwise be a single task.
PARTITION_BYTES = 4 << 20


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, url, html of a pages table."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), "url", "html")


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet", *, doc_id: str = "doc_id", html: str = "html", **options) -> DataFrame:
    """doc_id, html from Parquet, ORC, JSON or CSV columns; fmt="files" reads each file as a document, its path as id."""
    if fmt == "files":
        return spark.read.options(**options).text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("html"))
    return spark.read.options(**options).format(fmt).load(path).select(F.col(doc_id).alias("doc_id"), F.col(html).alias("html"))


def from_strings(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    """A small frame of given documents, numbered from 0."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, html string")


def spread(docs: DataFrame, *, html: str = "html", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Deals documents out evenly by row, into as many partitions as their bytes ask for.

    Worth it where few large files hold much text: the kernel's work is by the character and
    documents are independent, so rows may go anywhere.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length(html)), F.lit(0))).first()[0]
    return docs.repartition(max(1, -(-total // partition_bytes)))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Tokens, errors, trees or sanitized documents as files."""
    df.write.format(fmt).mode(mode).save(path)
