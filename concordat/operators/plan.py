"""From winners to a transfer plan, its gates, deletions and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FILE_FIELDS
from .diff import FULL_FIELDS, chunk_rows, node_chunks, signature


def winners(inventory: DataFrame, decided: DataFrame) -> DataFrame:
    """The winning inventory rows of decided (path, winner_node)."""
    won = decided.filter("winner_node is not null").select("path", F.col("winner_node").alias("node_idx"))
    return inventory.join(won, ["path", "node_idx"])


def transfers(inventory: DataFrame, decided: DataFrame, n_nodes: int, full_fields: Sequence[str] = FULL_FIELDS) -> DataFrame:
    """path, src_node, dst_node, trans_meta, trans_data: one aggregation by path,
    then one row for each other node that lacks or differs from the winner."""
    held = inventory.select("path", "node_idx", signature(full_fields).alias("full_sig"), signature(["chunks"]).alias("chunk_sig"))
    slots = held.groupBy("path").agg(F.collect_list(F.struct("node_idx", "full_sig", "chunk_sig")).alias("held"))  # at most one per node
    rows = slots.join(decided.filter("winner_node is not null").select("path", "winner_node"), "path")
    at = lambda i: F.get(F.filter("held", lambda v: v["node_idx"] == i), F.lit(0))
    rows = rows.withColumn("w", at(F.col("winner_node"))).filter("w is not null").withColumn("dst_node", F.explode(F.sequence(F.lit(0), F.lit(n_nodes - 1)))).filter("dst_node <> winner_node").withColumn("o", at(F.col("dst_node")))
    data = F.col("o").isNull() | (F.col("o.chunk_sig") != F.col("w.chunk_sig"))
    meta = F.col("o").isNull() | (F.col("o.full_sig") != F.col("w.full_sig"))
    return rows.select("path", F.col("winner_node").alias("src_node"), "dst_node", meta.alias("trans_meta"), data.alias("trans_data")).filter("trans_meta or trans_data")


def missing_chunks(inventory: DataFrame, plan: DataFrame) -> DataFrame:
    """dst_node, hash: the winner's chunks that a destination has in no file."""
    needed = plan.filter("trans_data").join(inventory.select("path", F.col("node_idx").alias("src_node"), "chunks"), ["path", "src_node"])
    needed = needed.select("dst_node", F.explode("chunks.hash").alias("hash")).distinct()
    owned = node_chunks(inventory).withColumnRenamed("node_idx", "dst_node")
    return needed.join(owned, ["dst_node", "hash"], "left_anti")


def chunk_sources(inventory: DataFrame) -> DataFrame:
    """hash, src_node (the lowest node that has it), size."""
    return chunk_rows(inventory).groupBy("hash").agg(F.min("node_idx").alias("src_node"), F.max("size").alias("size"))


def chunk_moves(inventory: DataFrame, missing: DataFrame) -> DataFrame:
    """hash, src_node, dst_node, size; a hash that no node has is left out and trips the gate."""
    return missing.join(chunk_sources(inventory), "hash").select("hash", "src_node", "dst_node", "size")


def chunk_targets(inventory: DataFrame, plan: DataFrame) -> DataFrame:
    """hash, src_node, dst_node, path, offset, size: every place to write, local copies
    (src_node = dst_node) included, so that repeated chunks all reach their files."""
    needed = plan.filter("trans_data").join(inventory.select("path", F.col("node_idx").alias("src_node"), "chunks"), ["path", "src_node"])
    needed = needed.select("path", "dst_node", F.explode("chunks").alias("c")).select("path", "dst_node", "c.hash", "c.offset", "c.size")
    own = node_chunks(inventory).select(F.col("node_idx").alias("dst_node"), "hash", F.lit(True).alias("own"))
    rows = needed.join(own, ["dst_node", "hash"], "left").join(chunk_sources(inventory).drop("size"), "hash", "left")
    return rows.select("hash", F.when(F.col("own"), F.col("dst_node")).otherwise(F.col("src_node")).alias("src_node"), "dst_node", "path", "offset", "size")


def transfer_matrix(moves: DataFrame) -> DataFrame:
    return moves.groupBy("src_node", "dst_node").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_chunks"))


def bytes_to_transfer(moves: DataFrame) -> DataFrame:
    """Each distinct hash counts once, however many destinations lack it."""
    return moves.groupBy("hash").agg(F.max("size").alias("size")).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.count(F.lit(1)).alias("n_hashes"))


def unserved(missing: DataFrame, moves: DataFrame) -> DataFrame:
    """Gate: missing chunks without a source; must be empty."""
    return missing.join(moves.select("hash", "dst_node"), ["hash", "dst_node"], "left_anti")


def empty_files(winner_rows: DataFrame) -> DataFrame:
    """Gate: files with bytes and no chunks; must be empty."""
    return winner_rows.filter("tp = 'F' and size > 0 and (chunks is null or size(chunks) = 0)").select("path", "size")


def affected_files(inventory: DataFrame, plan: DataFrame, missing: DataFrame) -> DataFrame:
    """dst_node, path: the first file of each node that waits for a missing chunk."""
    needed = plan.filter("trans_data").join(inventory.select("path", F.col("node_idx").alias("src_node"), "chunks"), ["path", "src_node"])
    needed = needed.select("path", "dst_node", F.explode("chunks.hash").alias("hash"))
    return needed.join(missing, ["dst_node", "hash"], "left_semi").groupBy("dst_node").agg(F.min("path").alias("path"))


def gate(rows: DataFrame, what: str, limit: int = 10) -> None:
    """Raise with the first rows unless the gate is empty."""
    bad = rows.limit(limit).collect()  # the report's length
    if bad:
        raise RuntimeError(f"{what}: " + "; ".join(map(str, bad)))


def delete_guard(deletes: DataFrame, prev: DataFrame, max_count: int | None = 1000, max_percent: int | None = 50, enabled: bool = True, mode: str = "sync") -> DataFrame:
    """n_deletes, n_total, percent, allowed, reason."""
    n = deletes.agg(F.count(F.lit(1)).alias("n_deletes"))
    both = n.join(F.broadcast(prev.agg(F.count(F.lit(1)).alias("n_total"))))  # one row each
    percent = F.when(F.col("n_total") > 0, F.expr("(n_deletes * 100) div n_total"))
    reason = F.when(F.lit(mode == "no-delete"), "mode").when(F.lit(not enabled), F.lit(None))
    if max_count is not None:
        reason = reason.when(F.col("n_deletes") > max_count, "count")
    if max_percent is not None:
        reason = reason.when(F.col("percent") > max_percent, "percent")
    both = both.withColumn("percent", percent).withColumn("reason", reason)
    return both.select("n_deletes", "n_total", "percent", F.col("reason").isNull().alias("allowed"), "reason")


def next_snapshot(inventory: DataFrame, decided: DataFrame, compat: bool = False) -> DataFrame:
    """The state to save: winners, and unless ``compat`` also what was in sync."""
    won = winners(inventory, decided).select(FILE_FIELDS)
    if compat:
        return won
    kept = decided.filter("status = 'none'").select("path")
    first = inventory.join(kept, "path", "left_semi")
    least = first.groupBy("path").agg(F.min("node_idx").alias("node_idx"))
    return won.unionByName(first.join(least, ["path", "node_idx"]).select(FILE_FIELDS))


def actions(plan: DataFrame, deletes: DataFrame, inventory: DataFrame, n_nodes: int) -> DataFrame:
    """node, op, path, tp, target: what an applier has to do; deleting is idempotent."""
    rows = plan.join(inventory.select("path", F.col("node_idx").alias("src_node"), "tp", "target", "mode", "mtime"), ["path", "src_node"])
    op = F.when(F.col("tp") == "D", "mkdir").when(F.col("tp") == "L", "symlink").when(F.col("trans_data"), "write").otherwise("touch")
    put = rows.select(F.col("dst_node").alias("node_idx"), op.alias("op"), "path", "tp", "target", "mode", "mtime")
    nodes = F.explode(F.sequence(F.lit(0), F.lit(n_nodes - 1)))
    none = F.lit(None)
    return put.unionByName(deletes.select(nodes.alias("node_idx"), F.lit("delete").alias("op"), "path", none.cast("string").alias("tp"), none.cast("string").alias("target"), none.cast("long").alias("mode"), none.cast("long").alias("mtime")))


def orphan_temporaries(inventory: DataFrame, suffix: str = ".concordat-tmp") -> DataFrame:
    """Left-over temporary entries, to be deleted (suffix: a fixed value of the staging format)."""
    return inventory.filter(F.col("path").endswith(suffix)).select("node_idx", F.lit("delete").alias("op"), "path")


def commit_summary(results: DataFrame) -> DataFrame:
    """renamed, failed of results (ok)."""
    return results.agg(F.count_if("ok").alias("renamed"), F.count_if(~F.col("ok")).alias("failed"))


def sync_result(decided: DataFrame, plan: DataFrame, moves: DataFrame, deletes: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row of counters; each side is a one-row aggregate."""
    kinds = plan.join(inventory.select("path", F.col("node_idx").alias("src_node"), "tp"), ["path", "src_node"])
    facts = [
        decided.agg(F.count_if(F.col("winner_node").isNotNull()).alias("files_synced"), F.count_if(F.col("status") == "conflict").alias("conflicts_encountered"), F.count_if((F.col("status") == "conflict") & F.col("winner_node").isNotNull()).alias("conflicts_resolved")),
        moves.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_transferred"), F.count(F.lit(1)).alias("chunks_transferred")),
        deletes.agg(F.count(F.lit(1)).alias("files_deleted")),
        kinds.agg(F.count_if(F.col("tp") == "D").alias("dirs_created")),
    ]
    out = facts[0]
    for f in facts[1:]:
        out = out.join(F.broadcast(f))
    return out


def with_resolution(diffed: DataFrame, resolved: DataFrame) -> DataFrame:
    """path, status, winner_node of all paths: winners, and conflicts as resolved."""
    choice = resolved.select("path", F.col("winner_node").alias("chosen"))
    picked: Column = F.when(F.col("status") == "winner", F.col("winner_node")).when(F.col("status") == "conflict", F.col("chosen"))
    return diffed.join(choice, "path", "left").select("path", "status", picked.alias("winner_node"))
