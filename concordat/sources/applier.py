"""Applying a plan's actions to a directory tree that all executors reach.

New content is staged beside its target and moved into place by ``commit``;
deleting what is not there is no error; nothing is touched in a dry run.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tree import scan_tree

#: Suffix of staged files.
STAGED = ".concordat-tmp"
RESULT = "op string, path string, ok boolean, error string"


def safe_path(root: str, path: str) -> str:
    if ".." in path.split("/") or path.startswith("/"):
        raise ValueError("unsafe path")
    return os.path.join(root, path)


def _perform(root: str, op: str, path: str, target, mode, mtime, content) -> None:
    full = safe_path(root, path)
    if op == "delete":
        if os.path.isdir(full) and not os.path.islink(full):
            os.rmdir(full)
        elif os.path.lexists(full):
            os.unlink(full)
        return
    if op == "touch":
        if mode is not None:
            os.chmod(full, mode)
        if mtime is not None:
            os.utime(full, (mtime, mtime))
        return
    os.makedirs(full if op == "mkdir" else os.path.dirname(full), exist_ok=True)
    if op == "symlink":
        if os.path.lexists(full):
            os.unlink(full)
        os.symlink(target, full)
    elif op == "write":
        with open(full + STAGED, "wb") as f:
            f.write(content or b"")
        if mode is not None:
            os.chmod(full + STAGED, mode)
        if mtime is not None:
            os.utime(full + STAGED, (mtime, mtime))


def apply(actions: DataFrame, root: str, contents: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """op, path, ok, error of actions (op, path, target, mode, mtime); contents: path, content (binary)."""
    rows = actions.select("op", "path", "target", "mode", "mtime")
    if contents is not None:
        rows = rows.join(contents.select("path", F.col("content").cast("binary").alias("content")), "path", "left").select("op", "path", "target", "mode", "mtime", "content")
    else:
        rows = rows.withColumn("content", F.lit(None).cast("binary"))
    # Deepest deletes first, directories before what they hold.
    rows = rows.withColumn("depth", F.size(F.split("path", "/")) * F.when(F.col("op") == "delete", -1).otherwise(1)).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.substring_index("path", "/", 1)).sortWithinPartitions("depth", "path").drop("depth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for op, path, target, mode, mtime, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                error = None
                if not dry_run:
                    try:
                        _perform(root, op, path, target, mode, mtime, content)
                    except (OSError, ValueError) as e:
                        error = str(e)
                out.append((op, path, error is None, error))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.string()), strict=True)], names=["op", "path", "ok", "error"])

    return rows.mapInArrow(run, RESULT)


def staged(spark, root: str) -> DataFrame:
    """path of the files staged beside their targets; the tree is walked by the executors."""
    return scan_tree(spark, root).filter(F.col("path").endswith(STAGED)).select("path", "tp")


def commit(spark, root: str) -> DataFrame:
    """renamed, failed: move all staged files into place, in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for path in batch.column(0).to_pylist():
                try:
                    full = os.path.join(root, path)
                    os.replace(full, full[: -len(STAGED)])
                    ok.append(True)
                except OSError:
                    ok.append(False)
            yield pa.RecordBatch.from_arrays([pa.array(ok, pa.bool_())], names=["ok"])

    return staged(spark, root).filter("tp <> 'D'").select("path").mapInArrow(run, "ok boolean").agg(F.count_if("ok").alias("renamed"), F.count_if(~F.col("ok")).alias("failed"))


def clean(spark, root: str) -> int:
    """Delete staged left-overs, files or empty directories; their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, tp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                full = os.path.join(root, path)
                os.rmdir(full) if tp == "D" else os.unlink(full)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return staged(spark, root).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
