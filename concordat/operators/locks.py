"""A table of locked paths on shared storage, which any number of processes change at once.

A holder's paths are written once, as Parquet.  The list of holders is the last entry of a
commit log; a change is the entry after the one that was read, and of several writers of
that entry one succeeds.  The others read again and look for conflicts only among the
holders that are new, so of two processes that want a path exactly one gets it, and
processes that want different paths all get theirs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import CommitLog, delete
from .state import LOCK_SECONDS


class Locked(RuntimeError):
    """A requested path is held."""


class LockTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = CommitLog(spark, f"{self.folder}/log")

    def _paths(self, tokens: Iterable[str]) -> DataFrame:
        return self.spark.read.schema("path string").parquet(*(f"{self.folder}/paths/{t}" for t in tokens))

    def holders(self) -> list[dict]:
        """token, pid, started, nodes of each holder: one for each process."""
        return self.log.latest()[1].get("holders", [])

    def held(self) -> DataFrame:
        """path, pid, started, nodes, token."""
        rows = [self._paths([h["token"]]).select("path", F.lit(h["pid"]).cast("long").alias("pid"), F.lit(h["started"]).cast("long").alias("started"), F.array(*map(F.lit, h["nodes"])).cast("array<string>").alias("nodes"), F.lit(h["token"]).alias("token")) for h in self.holders()]
        out = self.spark.createDataFrame([], "path string, pid long, started long, nodes array<string>, token string")
        for r in rows:
            out = out.unionAll(r)
        return out

    def acquire(self, requested: DataFrame, pid: int, started: int, nodes: Sequence[str] = ()) -> str:
        """Lock the requested paths (path), all or none; the token that releases them."""
        token = uuid.uuid4().hex
        requested.select("path").filter("path IS NOT NULL").distinct().write.parquet(f"{self.folder}/paths/{token}")
        own, checked = self._paths([token]), set()
        while True:
            version, entry = self.log.latest()
            holders = entry.get("holders", [])
            fresh = [h["token"] for h in holders if h["token"] not in checked]
            if fresh:
                taken = own.join(self._paths(fresh), "path", "left_semi").first()
                if taken:
                    delete(self.spark, f"{self.folder}/paths/{token}")
                    raise Locked(f"path is locked: {taken['path']}")
                checked |= set(fresh)
            if self.log.commit(version + 1, {"holders": [*holders, {"token": token, "pid": pid, "started": started, "nodes": list(nodes)}]}):
                return token

    def _remove(self, gone: Callable[[dict], bool]) -> int:
        while True:
            version, entry = self.log.latest()
            holders = entry.get("holders", [])
            out = [h["token"] for h in holders if gone(h)]
            if not out:
                return 0
            if self.log.commit(version + 1, {"holders": [h for h in holders if not gone(h)]}):
                for token in out:
                    delete(self.spark, f"{self.folder}/paths/{token}")
                return len(out)

    def release(self, token: str) -> bool:
        """Whether the token held anything."""
        return self._remove(lambda h: h["token"] == token) > 0

    def remove_stale(self, live_pids: Iterable[int], now: int) -> int:
        """Release what processes hold that are gone or began over a day ago; their number."""
        live = set(live_pids)
        return self._remove(lambda h: h["pid"] not in live or max(now - h["started"], 0) > LOCK_SECONDS)
