"""N-way alignment and the three-way diff.

Nodes are aligned by one aggregation per path, not by N outer joins; the
shuffle carries 128-bit signatures of the compared fields, not chunk lists, and
as numbers they keep the aggregation hashed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields that decide whether content or rights changed.
SIG_FIELDS = ("tp", "mode", "uid", "gid", "chunks")
#: Fields that decide whether replicas are the same; ctime only in compat mode.
FULL_FIELDS = ("tp", "mode", "uid", "gid", "chunks", "mtime", "size", "target")
COMPAT_FULL_FIELDS = (*FULL_FIELDS, "ctime")


def signature(fields: Sequence[str]) -> Column:
    """A never-null struct of two 64-bit hashes; nulls count by their place."""
    nulls = [F.col(f).isNull() for f in fields]
    return F.struct(F.xxhash64(*nulls, *fields).alias("a"), F.xxhash64(F.lit(1), *nulls, *fields).alias("b"))


def signed(inventory: DataFrame, full_fields: Sequence[str] = FULL_FIELDS) -> DataFrame:
    return inventory.withColumn("sig", signature(SIG_FIELDS)).withColumn("full_sig", signature(full_fields))


def _range(column: str) -> list[Column]:
    return [f(f"{column}.{part}").alias(f"{column}_{name}_{part}") for part in "ab" for name, f in (("lo", F.min), ("hi", F.max))]


def _one(column: str) -> Column:
    """Whether a group has one value of a signature."""
    return (F.col(f"{column}_lo_a") == F.col(f"{column}_hi_a")) & (F.col(f"{column}_lo_b") == F.col(f"{column}_hi_b"))


def diff(inventory: DataFrame, prev: DataFrame | None, n_nodes: int, full_fields: Sequence[str] = FULL_FIELDS) -> DataFrame:
    """path, status (none, winner, conflict), winner_node, n_present, n_versions, versions.

    Against a previous entry the nodes that changed compete; without one the
    first node is the winner unless another differs.  All replicas equal on all
    nodes is "none".  versions lists the present nodes in node order; n_versions
    counts runs of equal neighbours over all node slots, absence being a value.
    """
    rows = signed(inventory, full_fields)
    if prev is None:
        marked = rows.withColumn("has_prev", F.lit(False)).withColumn("changed", F.lit(False))
    else:
        old = prev.select("path", signature(SIG_FIELDS).alias("prev_sig"))
        marked = rows.join(old, "path", "left").withColumn("has_prev", F.col("prev_sig").isNotNull()).withColumn("changed", F.col("has_prev") & (F.col("sig") != F.col("prev_sig")))
    versions = F.array_sort(F.collect_list(F.struct("node_idx", "mtime", "size", "full_sig")))  # at most one per node
    grouped = marked.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_present"),
        F.bool_or("has_prev").alias("has_prev"),
        F.count_if("changed").alias("n_changed"),
        F.min(F.when(F.col("changed"), F.col("node_idx"))).alias("changed_node"),
        F.min("node_idx").alias("first_node"),
        *_range("sig"), *_range("full_sig"),
        versions.alias("versions"),
    )
    status = (
        F.when((F.col("n_present") == n_nodes) & _one("full_sig"), "none")
        .when(F.col("has_prev") & (F.col("n_changed") == 0), "none")
        .when(F.col("has_prev") & (F.col("n_changed") == 1), "winner")
        .when(F.col("has_prev"), "conflict")
        .when(_one("sig"), "winner")
        .otherwise("conflict")
    )
    slots = F.transform(F.sequence(F.lit(0), F.lit(n_nodes - 1)), lambda i: F.get(F.filter("versions", lambda v: v["node_idx"] == i), F.lit(0))["full_sig"])
    grouped = grouped.withColumn("status", status).withColumn("slots", slots)
    runs = F.size(F.filter("slots", lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(F.col("slots"), i - 1))))
    candidate = F.when(F.col("has_prev"), F.col("changed_node")).otherwise(F.col("first_node"))
    return grouped.select(
        "path", "status", F.when(F.col("status") == "winner", candidate).alias("winner_node"), F.col("n_present").cast("long").alias("n_present"), runs.cast("long").alias("n_versions"),
        F.transform("versions", lambda v: F.struct(v["node_idx"].alias("node_idx"), v["mtime"].alias("mtime"), v["size"].alias("size"))).alias("versions"),
    )


def deleted_paths(inventory: DataFrame, prev: DataFrame) -> DataFrame:
    """Paths of the snapshot that no node has."""
    return prev.select("path").join(inventory.select("path").distinct(), "path", "left_anti")


def presence_matrix(inventory: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, node_idx, present for every path and node, without a cross join:
    each path's present nodes are one small array, and nodes are few."""
    held = inventory.groupBy("path").agg(F.collect_set("node_idx").alias("held"))
    all_nodes = F.array(*(F.lit(r[0]) for r in nodes.select("node_idx").orderBy("node_idx").collect()))  # the node list is a program argument
    return held.select("path", "held", F.explode(all_nodes).alias("node_idx")).select("path", "node_idx", F.array_contains("held", F.col("node_idx")).alias("present"))


def collect_node(listing: DataFrame, order: str = "seq") -> DataFrame:
    """One row per (node_idx, path): the last listed wins."""
    last = Window.partitionBy("node_idx", "path").orderBy(F.desc(order))
    return listing.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")


def node_stats(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("node_idx").agg(
        F.count(F.lit(1)).alias("n_entries"), F.count_if(F.col("tp") == "F").alias("n_files"), F.count_if(F.col("tp") == "D").alias("n_dirs"),
        F.count_if(F.col("tp") == "L").alias("n_symlinks"), F.coalesce(F.sum(F.when(F.col("tp") == "F", F.col("size"))), F.lit(0)).alias("bytes"),
    )


def chunk_rows(inventory: DataFrame) -> DataFrame:
    return inventory.select("node_idx", "path", F.posexplode("chunks").alias("pos", "c")).select("node_idx", "path", F.col("pos").cast("long").alias("pos"), F.col("c.hash").alias("hash"), F.col("c.offset").alias("offset"), F.col("c.size").alias("size"))


def node_chunks(inventory: DataFrame) -> DataFrame:
    """The distinct chunk set of each node."""
    return chunk_rows(inventory).select("node_idx", "hash").distinct()


def inverted_index(chunks: DataFrame) -> DataFrame:
    """hash, n_locations (files that hold it), first (node_idx, path, offset): a row per chunk."""
    places = chunks.groupBy("hash", "node_idx", "path").agg(F.min("offset").alias("offset"))
    return places.groupBy("hash").agg(F.count(F.lit(1)).alias("n_locations"), F.min(F.struct("node_idx", "path", "offset")).alias("first"))


def locations(chunks: DataFrame) -> DataFrame:
    """hash, node_idx, path, offset, n_in_file: every file that holds a chunk, with its first place there.

    A row per place rather than a list per hash: a chunk that all files share is many rows.
    """
    return chunks.groupBy("hash", "node_idx", "path").agg(F.min("offset").alias("offset"), F.count(F.lit(1)).alias("n_in_file"))


def contiguity_violations(chunks: DataFrame) -> DataFrame:
    """Chunks that do not begin where the one before ends."""
    w = Window.partitionBy("node_idx", "path").orderBy("pos")
    expected = F.coalesce(F.lag(F.col("offset") + F.col("size")).over(w), F.lit(0))
    return chunks.withColumn("expected", expected).filter("offset <> expected")


def running_offsets(chunks: DataFrame) -> DataFrame:
    w = Window.partitionBy("node_idx", "path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("running_offset", F.coalesce(F.sum("size").over(w), F.lit(0)))


def version_letters(inventory: DataFrame) -> DataFrame:
    """A letter per distinct mtime of a path, oldest A; newest marks the last."""
    w = Window.partitionBy("path").orderBy("mtime")
    ranked = inventory.select("path", "node_idx", F.dense_rank().over(w).alias("rank"))
    top = F.max("rank").over(Window.partitionBy("path"))
    return ranked.select("path", "node_idx", F.chr(F.lit(64) + F.col("rank")).alias("letter"), (F.col("rank") == top).alias("newest"))


def version_row(inventory: DataFrame, n_nodes: int) -> DataFrame:
    """path, letters: each node's version letter, "-" where the node lacks the path.

    Letters go by distinct mtime, oldest A; past Z they are the code points that follow."""
    at = [F.max(F.when(F.col("node_idx") == i, F.col("mtime"))) for i in range(n_nodes)]
    rows = inventory.groupBy("path").agg(F.array(*at).alias("m"))
    times = F.array_sort(F.array_distinct(F.array_compact("m")))
    letter = lambda t: F.when(t.isNull(), "-").otherwise(F.decode(F.unhex(F.lpad(F.hex(F.lit(64) + F.array_position(times, t)), 4, "0")), "UTF-16BE"))
    return rows.select("path", F.transform("m", letter).alias("letters"))
