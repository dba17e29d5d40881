"""Chunk tracking and deduplication statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import hex_digest


def presence(local: DataFrame, remote: DataFrame) -> DataFrame:
    """hash, is_local, is_remote: one pass over both sides."""
    rows = local.select("hash", F.lit(True).alias("l"), F.lit(False).alias("r")).union(remote.select("hash", F.lit(False), F.lit(True)))
    return rows.groupBy("hash").agg(F.bool_or("l").alias("is_local"), F.bool_or("r").alias("is_remote"))


def dedup_stats(local: DataFrame, remote: DataFrame) -> DataFrame:
    p = presence(local, remote)
    return p.agg(F.count(F.lit(1)).alias("n_unique"), F.count_if("is_local").alias("n_local"), F.count_if("is_remote").alias("n_remote"), F.count_if(F.col("is_local") & F.col("is_remote")).alias("n_both"))


def on_both(local: DataFrame, remote: DataFrame) -> DataFrame:
    return local.select("hash").distinct().join(remote, "hash", "left_semi")


def all_available(local: DataFrame, remote: DataFrame) -> DataFrame:
    return local.select("hash").union(remote.select("hash")).distinct().orderBy("hash")


def missing(requested: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    return requested.select("hash").distinct().join(local, "hash", "left_anti").join(remote, "hash", "left_anti")


def sources(local: DataFrame, remote: DataFrame) -> DataFrame:
    """hash, origin, node_idx, offset: local places before remote ones."""
    side = lambda df, o, name: df.select("hash", F.lit(o).alias("rank"), F.lit(name).alias("origin"), "node_idx", "offset")
    return side(local, 0, "local").unionByName(side(remote, 1, "remote"))


def transfer_states(events: DataFrame) -> DataFrame:
    """hash, status, error: the last status of each chunk; completion without a start is an error."""
    last = events.groupBy("hash").agg(F.max(F.struct("seq", "status")).alias("s"), F.min(F.when(F.col("status") == "InProgress", F.col("seq"))).alias("started"), F.min(F.when(F.col("status") == "Completed", F.col("seq"))).alias("completed"))
    wrong = F.col("completed").isNotNull() & (F.col("started").isNull() | (F.col("started") > F.col("completed")))
    return last.select("hash", F.col("s.status").alias("status"), F.when(wrong, "completed before it began").alias("error"))


def tracker_stats(states: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return states.agg(F.count(F.lit(1)).alias("n_chunks"), count("Pending").alias("n_pending"), count("InProgress").alias("n_in_progress"), count("Completed").alias("n_completed"), count("Failed").alias("n_failed"))


def verified_read(requested: DataFrame, replicas: DataFrame, digest: Callable[[Column], Column] = hex_digest) -> DataFrame:
    """hash, node_idx, data: the first replica (by position) whose bytes have the digest.

    replicas: hash, position, node_idx, data; the digest (the chunker's, unless the
    hashes are of another kind) is taken before any shuffle, and a hash with many
    replicas is reduced map-side.
    """
    good = replicas.filter(digest(F.col("data")) == F.col("hash")).join(requested.select("hash").distinct(), "hash", "left_semi")
    return good.groupBy("hash").agg(F.min(F.struct("position", "node_idx", "data")).alias("r")).select("hash", "r.node_idx", "r.data")


def unreadable(requested: DataFrame, read: DataFrame) -> DataFrame:
    return requested.select("hash").distinct().join(read, "hash", "left_anti")


def reassemble(chunks: DataFrame, payloads: DataFrame) -> DataFrame:
    """node_idx, path, content (binary): chunk payloads in offset order; a file is one value, joined as
    hexadecimal text in linear work, so of 1 GB at most."""
    rows = chunks.select("node_idx", "path", "hash", "offset").join(payloads.select("hash", "data"), "hash")
    parts = F.array_sort(F.collect_list(F.struct("offset", "data")))
    return rows.groupBy("node_idx", "path").agg(parts.alias("parts")).select("node_idx", "path", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"].cast("binary"))), "")).alias("content"))
