"""Incremental reconciliation: inventories dropped into a folder are diffed as they come.

The state folder holds the newest row of each (node, path) in buckets of the path's hash, the
snapshot before in the same buckets, the stream's checkpoint and a commit log.  A batch
reads the buckets that its paths fall into, writes them anew under its own id, diffs its
paths, and commits: the entry of the batch's number says under which batch each bucket
lies.  A batch that is run again starts from the entry before it and replaces what it wrote,
so every row counts once whatever is interrupted.  A bucket's former version goes one
batch after the one that replaced it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import diff
from ..schemas import INVENTORY
from ..storage import CommitLog, delete, exists, scratch

#: Buckets of the seen inventories.
BUCKETS = 64


def _bucket(n: int):
    return F.pmod(F.xxhash64("path"), F.lit(n)).cast("int")


def _dealt(df: DataFrame, n: int, path: str) -> None:
    df.withColumn("bucket", _bucket(n)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def watch(spark: SparkSession, folder: str, prev: DataFrame | None, n_nodes: int, out: str, available_now: bool = False, state: str | None = None, buckets: int = BUCKETS, per_trigger: int | None = None) -> StreamingQuery:
    """Start a query that keeps the diff of all inventories seen so far in ``out``/<batch>.

    The newest listing of a (node, path) counts; within a batch the one with the greatest
    mtime, ctime and size.  Each batch diffs only the paths that it touched.  With a
    ``state`` folder a later call goes on where an earlier one ended, by crash or not; the
    snapshot is that of the first call.
    """
    state = (state or scratch(spark, "watch-state")).rstrip("/")
    log = CommitLog(spark, f"{state}/log")
    if prev is not None and not exists(spark, f"{state}/prev/_SUCCESS"):
        _dealt(prev, buckets, f"{state}/prev")

    def read(schema: T.StructType, paths: list[str]) -> DataFrame:
        found = [p for p in paths if exists(spark, p)]
        return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)

    def step(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        before, entry = log.latest(below=version + 1)
        if before == version:
            return
        at: dict[str, int] = entry.get("buckets", {})
        batch = batch.filter("path IS NOT NULL").persist()
        try:
            touched = sorted(r.bucket for r in batch.select(_bucket(buckets).alias("bucket")).distinct().collect())  # the buckets bound it
            old = read(INVENTORY, [f"{state}/seen/{at[str(b)]}/bucket={b}" for b in touched if str(b) in at])
            both = old.withColumn("_new", F.lit(0)).unionByName(batch.select(*INVENTORY.names).withColumn("_new", F.lit(1)))
            rest = [c for c in INVENTORY.names if c not in ("node_idx", "path")]
            last = both.groupBy("node_idx", "path").agg(F.max_by(F.struct(*rest), F.struct("_new", "mtime", "ctime", "size")).alias("r"))
            _dealt(last.select("node_idx", "path", "r.*").select(*INVENTORY.names), buckets, f"{state}/seen/{batch_id}")
            paths = batch.select("path").distinct()
            now = read(INVENTORY, [f"{state}/seen/{batch_id}/bucket={b}" for b in touched]).join(paths, "path", "left_semi")
            known = read(prev.schema, [f"{state}/prev/bucket={b}" for b in touched]) if prev is not None else None
            diff.diff(now, known, n_nodes).write.mode("overwrite").parquet(f"{out}/{batch_id}")
        finally:
            batch.unpersist()
        replaced = [f"{state}/seen/{at[str(b)]}/bucket={b}" for b in touched if str(b) in at]
        if log.commit(version, {"buckets": at | {str(b): batch_id for b in touched}, "replaced": replaced}):
            for path in entry.get("replaced", []):
                delete(spark, path)

    stream = spark.readStream.schema(INVENTORY).option("recursiveFileLookup", "true")
    if per_trigger:
        stream = stream.option("maxFilesPerTrigger", per_trigger)
    writer = stream.parquet(folder).writeStream.option("checkpointLocation", f"{state}/checkpoint").foreachBatch(step)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The last diff of each path."""
    rows = spark.read.parquet(f"{out}/*").withColumn("_b", F.regexp_extract(F.input_file_name(), r"/(\d+)/[^/]*$", 1).cast("int"))
    return rows.groupBy("path").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("path", "_b"))), "_b").alias("r")).select("path", "r.*")


def stop_all(spark: SparkSession) -> int:
    """Stop every running query between batches; their number."""
    active = spark.streams.active
    for q in active:
        q.stop()
    return len(active)
