"""The same operators over streams: each document stands alone, so none of them keeps state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.lex import parse_errors, tokenize


def read_stream(spark: SparkSession, path: str, schema: str = "doc_id long, html string", fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def token_stream(docs: DataFrame, **options) -> DataFrame:
    return tokenize(docs, **options)


def error_stream(docs: DataFrame, **options) -> DataFrame:
    return parse_errors(docs, **options)


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Everything there is by now, exactly once; start again for what comes later."""
    return df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """For sinks and operators that need a batch frame (sanitize groups by document): sink(batch, number)."""
    return df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
