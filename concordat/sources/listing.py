"""Listings as text lines: JSON rows, each file followed by its chunk rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codec import chunk_json, entry_json, parse_line

ROW = "typ string, pth string, mod long, uid long, gid long, ct long, mt long, sz long, tgt string, off long, len long, hsh string"


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, value; seq is the split's start and a number that grows within the split."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("seq"), "value")
    return rows


def parse_listing(lines: DataFrame) -> DataFrame:
    """file and inventory rows (without node) of lines (file, seq, value).

    A chunk row belongs to the last entry row before it; rows of unknown type
    or without JSON are skipped; S and L are symlinks; missing numbers are 0.

    With the seq of ``ordered_lines`` the last entry row is looked for within the split, and
    rows before a split's first entry take it from the splits before: of these there is
    one row each, so a file of any size is as many tasks as it has splits.
    """
    rows = lines.withColumn("r", F.from_json("value", ROW)).filter(F.col("r.typ").isin("F", "D", "S", "L", "C"))
    split = "block" in getattr(lines.schema["seq"].dataType, "names", ())
    rows = rows.withColumn("block", F.col("seq.block") if split else F.lit(0).cast("long"))
    head = F.when(F.col("r.typ") != "C", F.col("seq"))
    within = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("file", "block").agg(F.max(head).alias("last")).select("file", "block", F.max("last").over(earlier).alias("carried"))
    rows = rows.withColumn("entry", F.max(head).over(within)).join(carried, ["file", "block"], "left")
    rows = rows.withColumn("entry", F.coalesce("entry", "carried")).filter("entry IS NOT NULL")
    zero = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit(0).cast("long"))
    grouped = rows.groupBy("file", "entry").agg(
        F.max(F.when(F.col("r.typ") != "C", F.col("r"))).alias("e"),
        F.array_sort(F.collect_list(F.when(F.col("r.typ") == "C", F.struct("seq", F.col("r.hsh").alias("hash"), F.col("r.off").alias("offset"), F.col("r.len").alias("size"))))).alias("c"),
    )
    return grouped.filter("e.pth is not null").select(
        "file", F.col("e.pth").alias("path"), F.when(F.col("e.typ") == "S", "L").otherwise(F.col("e.typ")).alias("tp"), zero("mod").alias("mode"), zero("uid").alias("uid"), zero("gid").alias("gid"),
        zero("ct").alias("ctime"), zero("mt").alias("mtime"), zero("sz").alias("size"), F.transform("c", lambda x: F.struct(x["hash"].alias("hash"), x["offset"].alias("offset"), x["size"].alias("size"))).alias("chunks"), F.col("e.tgt").alias("target"),
    )


def listing_lines(inventory: DataFrame) -> DataFrame:
    """node_idx, path, pos, line: an entry line (pos -1) and its chunk lines."""
    entries = inventory.select("node_idx", "path", F.lit(-1).alias("pos"), entry_json().alias("line"))
    chunks = inventory.select("node_idx", "path", F.posexplode("chunks").alias("pos", "c")).select("node_idx", "path", "pos", chunk_json(F.col("c.hash"), F.col("c.offset"), F.col("c.size")).alias("line"))
    return entries.union(chunks)


def write_listing(inventory: DataFrame, path: str) -> None:
    """Text files; an entry's lines come from one row, so they stay together and in order
    without a shuffle."""
    lines = F.concat(F.array(entry_json()), F.coalesce(F.transform("chunks", lambda c: chunk_json(c["hash"], c["offset"], c["size"])), F.array().cast("array<string>")))
    inventory.select(F.explode(lines).alias("line")).write.text(path)


def parse_colon_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """lines (value) with the parsed colon row; strict raises on a malformed one."""
    out = lines.withColumn("r", parse_line(F.col("value")))
    if strict:
        out = out.withColumn("r", F.when(F.col("r.error").isNotNull(), F.raise_error(F.concat(F.col("r.error"), F.lit(": "), F.col("value")))).otherwise(F.col("r")))
    return out
