"""Files written to a tree by a two-phase commit.

``stage`` writes contents through a data source: each task attempt has a folder of its own
below the root, with a manifest of what it staged, and reports it in its commit message.
When all tasks are done the messages of those that count become one commit record, whole
or not at all; an aborted job leaves nothing.  ``finish`` then moves the recorded
files into place, in parallel by manifest; it may be run again after a crash, as a
file that has been moved is found in its place.  Counts come from the messages.

The root must be reachable by the driver and every executor as a folder.  An unsafe path
or a failing file is counted and reported, and does not stop the others; a null
content is an empty file; of rows that repeat a path one wins.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .applier import safe_path

#: Below the root: staging folders by job.
FOLDER = ".concordat/stage"
#: Errors that a task reports by name; all are counted.
REPORTED = 20
COLUMNS = "path string, content binary, mode long, mtime long"
RECORD = "commit.json"


@dataclass
class Staged(WriterCommitMessage):
    """What one task attempt staged."""

    folder: str
    n_files: int
    n_bytes: int
    n_failed: int
    errors: list


class StagedWriter(DataSourceWriter):
    def __init__(self, options):
        self.root, self.job = options["path"], options["job"]

    def write(self, iterator) -> Staged:
        context = TaskContext.get()
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}" if context else uuid.uuid4().hex
        folder = os.path.join(self.root, FOLDER, self.job, attempt)
        os.makedirs(folder, exist_ok=True)
        out = Staged(attempt, 0, 0, 0, [])
        with open(os.path.join(folder, "manifest"), "w") as manifest:
            for row in iterator:
                try:
                    safe_path(self.root, row.path)
                    name = str(out.n_files)
                    with open(os.path.join(folder, name), "wb") as f:
                        f.write(row.content or b"")
                    if row.mode is not None:
                        os.chmod(f.name, row.mode)
                    if row.mtime is not None:
                        os.utime(f.name, (row.mtime, row.mtime))
                except (OSError, ValueError) as e:
                    out.n_failed += 1
                    if len(out.errors) < REPORTED:
                        out.errors.append([row.path, str(e)])
                    continue
                manifest.write(json.dumps([name, row.path]) + "\n")
                out.n_files += 1
                out.n_bytes += len(row.content or b"")
        return out

    def commit(self, messages) -> None:
        """One record names the attempts that count."""
        folder = os.path.join(self.root, FOLDER, self.job)
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, RECORD + ".tmp"), "w") as f:
            json.dump([asdict(m) for m in messages if m is not None], f)
        os.replace(f.name, os.path.join(folder, RECORD))

    def abort(self, messages) -> None:
        shutil.rmtree(os.path.join(self.root, FOLDER, self.job), ignore_errors=True)


class StagedSource(DataSource):
    @classmethod
    def name(cls):
        return "staged"

    def schema(self):
        return COLUMNS

    def writer(self, schema, overwrite):
        return StagedWriter(self.options)


def stage(files: DataFrame, root: str) -> str:
    """Stage files (path, content, mode, mtime) below the root; the job to finish."""
    spark, job = files.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(StagedSource)
    files.select("path", F.col("content").cast("binary").alias("content"), F.col("mode").cast("long").alias("mode"), F.col("mtime").cast("long").alias("mtime")).write.format("staged").mode("append").option("path", root).option("job", job).save()
    return job


def recorded(root: str, job: str) -> list[dict]:
    """The messages of a committed job; none of one that was aborted or is under way."""
    try:
        with open(os.path.join(root, FOLDER, job, RECORD)) as f:
            return json.load(f)
    except FileNotFoundError:
        return []


def jobs(root: str) -> list[str]:
    """Jobs that have been staged and not finished."""
    folder = os.path.join(root, FOLDER)
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def finish(spark: SparkSession, root: str, job: str) -> dict:
    """Move a committed job's files into place: staged, bytes, failed, errors of staging, and renamed,
    already (in their place), lost of moving.  What no record names goes with the folder."""
    messages = recorded(root, job)
    base = os.path.join(root, FOLDER, job)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                n = {"renamed": 0, "already": 0, "lost": 0}
                with open(os.path.join(base, folder, "manifest")) as f:
                    for name, path in map(json.loads, f):
                        target = safe_path(root, path)
                        try:
                            os.makedirs(os.path.dirname(target), exist_ok=True)
                            os.replace(os.path.join(base, folder, name), target)
                            n["renamed"] += 1
                        except FileNotFoundError:
                            n["already" if os.path.lexists(target) else "lost"] += 1
                        except OSError:
                            n["lost"] += 1
                yield pa.RecordBatch.from_pylist([n])

    counts = {"renamed": 0, "already": 0, "lost": 0}
    if messages:
        folders = spark.createDataFrame([(m["folder"],) for m in messages], "folder string").repartition(len(messages))
        moved = folders.mapInArrow(move, "renamed long, already long, lost long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts))
        counts = moved.first().asDict()
    shutil.rmtree(base, ignore_errors=True)
    total = lambda k: sum(m[k] for m in messages)
    return {"staged": total("n_files"), "bytes": total("n_bytes"), "failed": total("n_failed"), "errors": [tuple(e) for m in messages for e in m["errors"]], **counts}
