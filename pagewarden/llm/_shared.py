"""Helpers that several operators use: the shared folder, cut lineage and file access."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Word separators of the text contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, one is made for a local session and a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/pagewarden-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch between the JVM and a Python worker while a table is staged: each side holds several of them outside its heap.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of about BATCH_BYTES for the jobs inside; the session's own setting comes back after them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, own)


def lean(spark: SparkSession) -> None:
    """Small Arrow batches for all of a session's jobs: for applications and queries, whose last job their caller runs."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def staged(df: DataFrame, directory: str, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a reread of finished files, not a recomputation.
    """
    path = f"{directory}/{label}"
    with small_batches(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, directory: str, *labels: str) -> None:
    """Delete staged tables that nothing reads any more."""
    conf = spark._jsc.hadoopConfiguration()
    for label in labels:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/{label}")
        path.getFileSystem(conf).delete(path, True)


def dealt(files: DataFrame) -> DataFrame:
    """A table of file names over as many partitions as the session shuffles to: a name is short but its file is not,
    so the partitions must not be merged by their bytes, and rows go round, as hashing would keep those of an aggregation in place."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}" if not uri.startswith("file:") else uri)


@contextmanager
def writing(uri: str) -> Iterator:
    """An output stream to a new file of a shared file system.

    Names are unique to a task attempt and only files named in a finished manifest are ever read, so a lost
    or repeated attempt leaves at most an orphan file.
    """
    system, path = _file_system(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        yield out


@contextmanager
def reading(uri: str) -> Iterator:
    system, path = _file_system(uri)
    with system.open_input_file(path) as source:
        yield source
