"""A session with what the operators rely on; on a cluster the given settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "pagemill", **conf: str) -> SparkSession:
    """UTC, adaptive plans with skew handling, Arrow batches bounded in bytes; conf with _ for dots overrides."""
    b = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
