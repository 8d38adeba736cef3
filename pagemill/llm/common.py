"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a folder of our own in local mode (tests), and an error on a cluster."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        there = spark.sparkContext.getCheckpointDir()
    if not there:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="pagemill-")
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, and safe when executors are lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more: disk is shared by all stages of a job."""
    spark = df.sparkSession
    if files := df.inputFiles():
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def pick(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, as new name = old name; other columns of docs can't clash then."""
    return docs.select([F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Row tuples of the named columns, a slice at a time."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows and bytes of the batches that texts travel in to Python workers; set where the session has Spark's defaults.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def small_batches(spark: SparkSession) -> None:
    """Bounds what a worker holds of its input at once, on both sides of the pipe."""
    for key, (usual, small) in BATCH.items():
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, small)


@lru_cache(maxsize=1)
def _trimmer() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def _resident() -> int:
    """Bytes of memory this process holds; beyond all bounds where that can't be told."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096
    except OSError:
        return 1 << 62


def trim(beyond: int = 140 << 20) -> None:
    """Gives freed memory back to the system where a worker holds much: workers are reused, and what one task needed would stay with them."""
    if _resident() > beyond:
        pa.default_memory_pool().release_unused()
        if f := _trimmer():
            f(0)


def trimmed(f: Callable) -> Callable:
    """f, a worker function on batches or on groups, with trim() after it."""

    @wraps(f)
    def batches(it):
        try:
            yield from f(it)
        finally:
            trim()

    return batches


def trimmed_group(f: Callable) -> Callable:
    def group(data):
        out = f(data)
        del data
        trim()
        return out

    return group


def trimmed_pair(f: Callable) -> Callable:
    def pair(left, right):
        out = f(left, right)
        del left, right
        trim()
        return out

    return pair
