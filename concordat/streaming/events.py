"""Event streams: the same expressions serve batches and Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import changed, exists, scratch


def read_stream(spark: SparkSession, folder: str, table: str, per_trigger: int = 100) -> DataFrame:
    """A table of a folder as a file stream; per_trigger bounds a batch's files."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").option("maxFilesPerTrigger", per_trigger).parquet(folder)


#: The state store that arbitrary state needs.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_available(stream: DataFrame, mode: str, name: str, keys: tuple[str, ...] = (), order: tuple[str, ...] = (), folder: str | None = None, settings: dict[str, str] | None = None, each: Callable[[DataFrame, int, str], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what is there; its result as a table in shared storage.

    A batch writes the folder of its own id, so one that is run again replaces what it wrote.
    Update mode: the last row of each key, by batch and then ``order``.  ``folder`` keeps
    rows and checkpoint for a later call, which goes on where this one ended.  ``each`` (batch,
    id, folder) gives the rows to write of a batch, with the stream's columns.
    """
    spark = stream.sparkSession
    folder = folder or scratch(spark, name)
    out = f"{folder}/rows"

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = each(batch, batch_id, folder) if each else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write)
    with changed(spark, settings or {}):
        query = writer.start()
    query.awaitTermination()
    if not exists(spark, out):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    if not keys:
        return rows.drop("batch")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), F.struct("batch", *order)).alias("r"))
    return last.select("r.*")


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One batch to several sinks; it is computed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return write


#: Event names by kind (the driver's events stand for the engine's own).
STATUS = {"view": "exists", "click": "pending", "signup": "syncing", "purchase": "synced", "error": "failed"}


def translate(events: DataFrame) -> DataFrame:
    """seq, ts, node_idx, path, status, bytes of raw events."""
    status = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in STATUS.items()), F.lit("unknown"))
    return events.select(
        F.col("event_id").alias("seq"), "ts", (F.col("user_id") % 3).cast("int").alias("node_idx"), F.concat(F.lit("file/"), F.col("user_id").cast("string")).alias("path"),
        status.alias("status"), F.floor(F.col("value") * 100).cast("long").alias("bytes"),
    )


def latest_status(events: DataFrame) -> DataFrame:
    """path, node_idx, status (the last), ever_failed."""
    last = events.groupBy("path", "node_idx").agg(F.max(F.struct("seq", "status")).alias("s"), F.bool_or(F.col("status") == "failed").alias("ever_failed"))
    return last.select("path", "node_idx", F.col("s.status").alias("status"), "ever_failed")


def progress(events: DataFrame) -> DataFrame:
    return events.groupBy("node_idx").agg(F.count(F.lit(1)).alias("n_events"), F.sum("bytes").alias("bytes"), F.count_if(F.col("status") == "synced").alias("n_synced"), F.max("seq").alias("last_seq"))


def sent_received(operations: DataFrame) -> DataFrame:
    """node_idx, sent, received of operations (src_node, dst_node, op, bytes); deletes and empty ones do not count."""
    real = operations.filter("op <> 'delete' and bytes > 0")
    sides = real.select(F.explode(F.array(F.struct(F.col("src_node").alias("node_idx"), F.col("bytes").alias("sent"), F.lit(0).cast("long").alias("received")), F.struct(F.col("dst_node").alias("node_idx"), F.lit(0).cast("long").alias("sent"), F.col("bytes").alias("received")))).alias("s"))
    return sides.groupBy("s.node_idx").agg(F.sum("s.sent").alias("sent"), F.sum("s.received").alias("received"))


def phase_durations(events: DataFrame) -> DataFrame:
    """seq, path, status, seconds until the path's next event; null for the last."""
    w = Window.partitionBy("path").orderBy("ts", "seq")
    seconds = F.timestamp_diff("SECOND", F.col("ts"), F.lead("ts").over(w))
    return events.select("seq", "path", "status", seconds.alias("seconds"))


def last_logs(events: DataFrame, n: int = 100) -> DataFrame:
    """The newest n records: a top-k, not a sort of all."""
    return events.orderBy(F.desc("seq")).limit(n)


def throttle(events: DataFrame, gap_seconds: int) -> DataFrame:
    """The first event of each node and window of gap_seconds."""
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (gap_seconds * 1_000_000))
    return events.withColumn("slot", slot).groupBy("node_idx", "slot").agg(F.min("seq").alias("seq"))


def resolutions(stream: DataFrame, conflicts: DataFrame) -> DataFrame:
    """path, winner_node: of the valid choices (seq, path, chosen_node) the first of each path.

    The pending conflicts are a static table; the choices may be a stream, whose
    state is one row per resolved path (complete or update mode).
    """
    joined = stream.join(conflicts.select("path", "versions"), "path").filter((F.col("chosen_node") >= 0) & (F.col("chosen_node") < F.size("versions")))
    picked = joined.select("seq", "path", F.get("versions", F.col("chosen_node"))["node_idx"].alias("winner_node"))
    return picked.groupBy("path").agg(F.min(F.struct("seq", "winner_node")).alias("r")).select("path", "r.winner_node")
