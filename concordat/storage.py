"""Shared storage: the folder that spark.checkpoint.dir names, else (on a local master) a local one.

What is written under ``scratch`` lives as long as the application: the file
system is told to delete it when the driver ends.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="concordat-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + _LOCAL[app]


_FOLDERS: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path of the application's own folder, which goes with the application."""
    folder = f"{shared_root(spark)}/concordat-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to shared storage and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(source).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(source), path(target))


@contextmanager
def changed(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings changed for a while."""
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def file_system(spark: SparkSession, path: str):
    """(file system, Hadoop path)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    fs, p = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole text unless it is there; whether this call did.

    Of any number of callers one creates it: the text is written under a name of its own,
    which is then linked (local file systems) or renamed (file systems whose rename fails
    on what exists, as HDFS) to the path.
    """
    fs, p = file_system(spark, path)
    fs.mkdirs(p.getParent())
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(own, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    real = fs.resolvePath(own).toUri()
    if real.getScheme() not in (None, "file"):
        if fs.rename(own, p):
            return True
        fs.delete(own, False)
        return False
    try:
        os.link(real.getPath(), os.path.join(os.path.dirname(real.getPath()), p.getName()))
        return True
    except FileExistsError:
        return False
    finally:
        fs.delete(own, False)


class CommitLog:
    """Numbered entries of a folder; each number is committed once, whole, by one writer."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def versions(self) -> list[int]:
        return [int(x[:-5]) for x in names(self.spark, self.folder) if len(x) == 25 and x.endswith(".json")]

    def latest(self, below: int | None = None) -> tuple[int, dict]:
        """The greatest version (below a bound) and its entry; 0 and {} if there is none."""
        version = max((v for v in self.versions() if below is None or v < below), default=0)
        return version, json.loads(read_text(self.spark, self._path(version))) if version else {}

    def commit(self, version: int, entry: dict) -> bool:
        return create_once(self.spark, self._path(version), json.dumps(entry))

    def _path(self, version: int) -> str:
        return f"{self.folder}/{version:020d}.json"
