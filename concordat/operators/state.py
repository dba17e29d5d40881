"""Scan cache, stale locks (``locks`` has the table that takes them), protocol versions, and configuration checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A lock is too old after a day (fixed value).
LOCK_SECONDS = 86_400


def cache_hits(scan: DataFrame, cache: DataFrame) -> DataFrame:
    """scan with the cached chunks where path and mtime agree, and hit."""
    known = cache.select("path", "mtime", F.col("chunks").alias("cached_chunks"), F.lit(True).alias("_hit"))
    return scan.join(known, ["path", "mtime"], "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def cache_put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache after writing entries: the newer of a path wins."""
    rows = cache.withColumn("_new", F.lit(0)).unionByName(entries.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("path").orderBy(F.desc("_new"), F.desc("mtime"))
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_new")


def cache_valid(entries: DataFrame, now: int, ttl: int) -> DataFrame:
    """entries (created, mtime, current_mtime) with valid and file_valid."""
    live = F.lit(now) < F.col("created") + ttl
    return entries.withColumn("valid", live).withColumn("file_valid", live & (F.col("mtime") == F.col("current_mtime")))


def stale_locks(locks: DataFrame, live_pids: DataFrame, now: int) -> DataFrame:
    """locks with stale: the process is gone or the lock is over a day old."""
    alive = live_pids.select("pid", F.lit(True).alias("_alive")).distinct()
    old = F.greatest(F.lit(now) - F.col("started"), F.lit(0)) > LOCK_SECONDS
    return locks.join(alive, "pid", "left").withColumn("stale", F.col("_alive").isNull() | old).drop("_alive")


def cleaned_locks(locks: DataFrame, live_pids: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(surviving locks, one row n_removed)."""
    rows = stale_locks(locks, live_pids, now)
    return rows.filter("not stale").drop("stale"), rows.agg(F.count_if("stale").alias("n_removed"))


def lock_conflicts(requested: DataFrame, locks: DataFrame) -> DataFrame:
    return requested.select("path").join(locks, "path", "left_semi")


def common_version(versions: DataFrame) -> DataFrame:
    """version: the greatest that every node speaks; null if there is none. versions: node_idx, version."""
    n = versions.agg(F.countDistinct("node_idx").alias("n"))
    shared = versions.groupBy("version").agg(F.countDistinct("node_idx").alias("k")).join(F.broadcast(n)).filter("k = n")
    return shared.agg(F.max("version").alias("version"))


def check_config(chunk_bits: int = 20, cache_size: int = 1, retries: int = 0, timeout: int = 30) -> None:
    """Ranges of settings (fixed values)."""
    for ok, what in ((8 <= chunk_bits <= 32, "chunk bits within 8 and 32"), (cache_size > 0, "a cache size over 0"), (0 <= retries <= 100, "at most 100 retries"), (1 <= timeout <= 3600, "a timeout within 1 and 3600 seconds")):
        if not ok:
            raise ValueError(f"expected {what}")
