"""Shared-storage and batching helpers of the training-data operators.

Intermediate tables and files go to the folder that ``spark.checkpoint.dir``
names, which the driver and every executor can reach.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..storage import delete, scratch

__all__ = ["discard", "few_tasks", "materialize", "open_fs", "partitions", "publish", "scratch", "settings", "small_batches"]


#: Deletes a finished query's shuffle files at once, rather than when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings changed for a while."""
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, values: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to shared storage and read it back; values: settings for that query.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation.  The
    query's shuffle files go as soon as it has been written.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with settings(spark, {CLEANUP: "true"} | (values or {})):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later plan reads."""
    for t in tables:
        delete(t.sparkSession, t.stored_at)


#: Rows of a few numbers that one task writes with ease.
TASK_ROWS = 50_000


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df, whose rows are short and at most ``rows``, in so few partitions that a task has TASK_ROWS or two are left."""
    return df.coalesce(2 + rows // TASK_ROWS)


def small_batches(spark: SparkSession, records: int = 512) -> None:
    """Bound Arrow batches, as one text may be long: at most ``records`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > records:
        spark.conf.set(key, str(records))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def open_fs(uri: str):
    """(file system, path) for a URI of shared storage."""
    import pyarrow.fs as fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        path = uri[5:]
        return fs.LocalFileSystem(), "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, write) -> int:
    """Create the file ``uri`` in one step; returns its bytes.

    ``write(stream)`` fills a file of a name of its own, which is then moved:
    a retried or a speculative task leaves one whole file, never a torn one.
    """
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(own, compression=None) as out:
        write(out)
        n = out.tell()
    fs.move(own, path)
    return n
