"""A directory tree as a table: lstat rows of files, directories and symlinks.

``spark.read.format("tree").option("path", ...)``: directories are opened from the root down until
there are enough of them for all cores, and each is then walked by a task; excluded
directories are never entered.  The root must be reachable by every executor.

``spark.readStream.format("tree")``: offsets are moments.  A trigger walks the trees in the same
tasks and returns the entries whose inode changed (ctime: content, mode, owner, name) since
the last one, so the first returns all.  Its end is ``MARGIN`` before now, as file systems
stamp by a coarser clock.  What is gone shows as a change of its directory.
"""

from __future__ import annotations

import os
import re
import stat
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.globs import to_regex

SCHEMA = "node_idx int, path string, tp string, mode long, uid long, gid long, ctime long, mtime long, size long, target string, error string"
WRAP = 1 << 32
#: Directories opened one by one to find enough for all tasks, at most.
OPENED = 1024
#: Nanoseconds before now at which a trigger ends.
MARGIN = 1_000_000_000


class Subtree(InputPartition):
    """Entries of a directory to be walked (deep), or told of alone."""

    def __init__(self, paths: list[str], deep: bool, since: int | None = None, until: int | None = None):
        super().__init__(paths)
        self.deep, self.since, self.until = deep, since, until


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.node, self.tasks = options["path"], int(options.get("node", "0")), int(options.get("tasks", "32"))
        exclude = [to_regex(g).removeprefix("(?s)") for g in options.get("exclude", "").split("\n") if g]
        self.exclude = "|".join(exclude)

    def _excluded(self):
        return re.compile(self.exclude, re.S).search if self.exclude else lambda _: None

    def partitions(self):
        return self.subtrees()

    def subtrees(self, since: int | None = None, until: int | None = None) -> list[Subtree]:
        """Directories are opened, widest level first, until there are as many as tasks."""
        excluded, told, level, opened = self._excluded(), [], [""], 0
        while level and len(level) < self.tasks and opened < OPENED:
            below = []
            for at, path in enumerate(level):
                if opened >= OPENED:
                    below += level[at:]
                    break
                opened += 1
                if path:
                    told.append(path)
                try:
                    with os.scandir(os.path.join(self.root, path)) as entries:
                        for e in sorted(entries, key=lambda e: e.name):
                            name = os.path.join(path, e.name)
                            if not excluded(name):
                                (below if e.is_dir(follow_symlinks=False) else told).append(name)
                except OSError:
                    if not path:
                        raise
            level = below
        step = -(-len(told) // self.tasks) or 1
        parts = [Subtree([path], True, since, until) for path in level] + [Subtree(told[i : i + step], False, since, until) for i in range(0, len(told), step)]
        return parts or [Subtree([], False)]

    def read(self, partition) -> Iterator[tuple]:
        excluded = self._excluded()
        stack = list(reversed(partition.value))
        while stack:
            path = stack.pop()
            if excluded(path):
                continue
            full = os.path.join(self.root, path)
            try:
                s = os.lstat(full)
                # A directory that the driver opened is only checked, so that its error is told.
                inside = sorted(os.listdir(full), reverse=True) if stat.S_ISDIR(s.st_mode) else []
                error = None
            except OSError as e:
                error, inside = str(e), []
                if not os.path.lexists(full) or not stat.S_ISDIR(os.lstat(full).st_mode):
                    yield (self.node, path, None, None, None, None, None, None, None, None, error)
                    continue
                s = os.lstat(full)
            tp = "F" if stat.S_ISREG(s.st_mode) else "D" if stat.S_ISDIR(s.st_mode) else "L" if stat.S_ISLNK(s.st_mode) else None
            if tp is None:
                continue
            if tp == "D" and partition.deep:
                stack += [os.path.join(path, name) for name in inside]
            if partition.until is not None and not partition.since < s.st_ctime_ns <= partition.until:
                continue
            target = os.readlink(full) if tp == "L" else None
            yield (self.node, path, tp, stat.S_IMODE(s.st_mode), s.st_uid, s.st_gid, int(s.st_ctime) % WRAP, int(s.st_mtime) % WRAP, s.st_size if tp == "F" else 0, target, None)
            if error:
                yield (self.node, path, None, None, None, None, None, None, None, None, error)


class TreeStreamReader(TreeReader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"ns": -1}

    def latestOffset(self) -> dict:
        return {"ns": time.time_ns() - MARGIN}

    def partitions(self, start: dict, end: dict):
        return self.subtrees(start["ns"], end["ns"])

    def commit(self, end: dict) -> None:
        pass


class TreeSource(DataSource):
    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TreeReader(self.options)

    def streamReader(self, schema):
        return TreeStreamReader(self.options)


def scan_tree(spark: SparkSession, root: str, node: int = 0, exclude: tuple[str, ...] = ()):
    spark.dataSource.register(TreeSource)
    tasks = max(32, 4 * spark.sparkContext.defaultParallelism)
    return spark.read.format("tree").option("path", root).option("node", node).option("tasks", tasks).option("exclude", "\n".join(exclude)).load()


def watch_tree(spark: SparkSession, root: str, node: int = 0, exclude: tuple[str, ...] = ()):
    """The tree's changes as a stream."""
    spark.dataSource.register(TreeSource)
    tasks = max(32, 4 * spark.sparkContext.defaultParallelism)
    return spark.readStream.format("tree").option("path", root).option("node", node).option("tasks", tasks).option("exclude", "\n".join(exclude)).load()


def read_contents(rows, root: str):
    """node_idx, path, content of a scan's files, a file a batch; unreadable ones have null content."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for at, path in enumerate(batch.column(1).to_pylist()):
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        data = f.read()
                except OSError:
                    data = None
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), batch.column(1).slice(at, 1), pa.array([data], pa.binary())], names=["node_idx", "path", "content"])

    return rows.filter("tp = 'F'").select("node_idx", "path").mapInArrow(run, "node_idx int, path string, content binary")
