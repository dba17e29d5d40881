"""Throttled progress: which of a key's events are shown.

``thin`` keeps an event if at least ``gap`` has passed since the last one *kept*, or if its
number is a multiple of ``every``; either way the gap begins anew.  Each kept event thus
depends on the one before.  In batches the recurrence is solved without walking a key
from end to end: events are dealt into ranges of (key, time), and within a range every event
points to the next that would be kept after it.  Doubling these pointers gives, for each
event a range may begin with, the last event kept in it: a step function of the time
carried in.  A key's functions, of which there is one a range, are then applied one
after the other, and each range marks its own events from the time carried into it.
In streams the last time kept and the number of events are a key's state: ``thin_batch``
solves each batch as above from that state, a table of a row a key; ``thin_stream`` walks a key's rows of a
batch in one Python worker, for streams of many keys and small batches.

Times are microseconds.  Ties of time go by ``seq``.  Null keys and times take no part.  The first
event is kept, or with ``begun`` (the time the count starts from) waits for its gap as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..storage import delete, stored

NEVER = np.iinfo(np.int64).min // 2
#: Rows of a range, about: what a task holds at a time.
RANGE_ROWS = 1 << 18


def pointers(t: np.ndarray, gap: int, forced: np.ndarray) -> np.ndarray:
    """The next event kept after each kept one; len(t) where that is past the end."""
    after = np.searchsorted(t, t + gap, "left")
    after = np.maximum(after, np.arange(1, len(t) + 1))
    at = np.append(np.flatnonzero(forced), len(t))
    return np.minimum(after, at[np.searchsorted(at, np.arange(len(t)), "right")])


def ends(after: np.ndarray) -> np.ndarray:
    """The last event kept in the range, were each event kept: pointers doubled until none moves."""
    n = len(after)
    jump = np.append(np.where(after < n, after, np.arange(n)), n)
    while True:
        further = jump[jump]
        if (further == jump).all():
            return jump[:n]
        jump = further


def chain(after: np.ndarray, first: int) -> np.ndarray:
    """Marks of the events kept from ``first`` on: the marked ones mark those 1, 2, 4, ... further."""
    n = len(after)
    kept = np.zeros(n + 1, bool)
    if first < n:
        kept[first] = True
        jump = np.append(after, n)
        while True:
            before = kept.sum()
            kept[jump[np.flatnonzero(kept)]] = True
            if kept.sum() == before:
                break
            jump = jump[jump]
    return kept[:n]


def entry(t: np.ndarray, carried: int, gap: int, forced: np.ndarray) -> int:
    """The first event kept after a last one at ``carried``."""
    at = np.flatnonzero(forced)
    return min(int(np.searchsorted(t, carried + gap, "left")), int(at[0]) if len(at) else len(t))


def steps(t: np.ndarray, gap: int, forced: np.ndarray) -> tuple[list[int], list[int]]:
    """The last kept time as a function of the one carried in: up to each bound, a result.

    A result of NEVER leaves the carried time as it is.  Entries that meet share a step.
    """
    last = ends(pointers(t, gap, forced))
    stop = int(np.append(np.flatnonzero(forced), len(t))[0])  # the first event kept is this one at the latest
    at = np.flatnonzero(np.append(np.diff(last[: stop + 1]) != 0, True))
    bounds, results = [int(x) - gap for x in t[at]], [int(x) for x in t[last[at]]]
    if stop < len(t):
        bounds[-1] = -NEVER
    else:
        bounds.append(-NEVER)
        results.append(NEVER)
    return bounds, results


def _ranges(events: DataFrame, key: str, time: str, seq: str) -> DataFrame:
    """The events by (key, time, seq), with their range and their number in it."""
    rows = events.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    n = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows.count() // RANGE_ROWS))
    rows = rows.repartitionByRange(n, key, time, seq).sortWithinPartitions(key, time, seq).withColumn("_range", F.spark_partition_id())
    return stored(rows, "throttle")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each (range, key): one range is one task, which holds a group at a time."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.Table:
        return pa.Table.from_batches(held)

    for b in batches:
        if not b.num_rows:
            continue
        k = pd.MultiIndex.from_arrays([b.column("_range").to_pandas(), b.column(key).to_pandas()])
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        for first, end in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            part = b.slice(first, end - first)
            if held and (held[-1].column(key)[-1] != part.column(key)[0] or held[-1].column("_range")[-1] != part.column("_range")[0]):
                yield whole()
                held = []
            held.append(part)
    if held:
        yield whole()


def thin(events: DataFrame, key: str, time: str, seq: str, gap: int, every: int | None = None, begun: Column | None = None) -> DataFrame:
    """The events kept, with all their columns; time: microseconds, gap: at least 1."""
    return _thin(_ranges(events, key, time, seq), key, time, seq, gap, every, begun)


def _thin(rows: DataFrame, key: str, time: str, seq: str, gap: int, every: int | None, begun: Column | None, state: DataFrame | None = None) -> DataFrame:
    """The events kept of ranges; state (key, _last, _number): where keys go on."""
    columns = [c for c in rows.columns if c != "_range"]
    n = (rows.agg(F.max("_range")).first()[0] or 0) + 1
    kind = rows.schema[key].dataType.simpleString()
    sizes = rows.groupBy("_range", key).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    start = F.coalesce(begun.cast("long"), F.lit(NEVER)) if begun is not None else F.lit(NEVER)
    if state is not None:
        sizes = sizes.join(state, key, "left").withColumn("_before", F.col("_before") + F.coalesce("_number", F.lit(0)))
    numbered = rows.join(sizes.select("_range", key, "_before"), ["_range", key])  # a row for each key and range that meet

    def by_range(df: DataFrame) -> DataFrame:
        return df.repartitionById(n, F.col("_range")).sortWithinPartitions("_range", key, time, seq)

    def forced(g: pa.Table) -> np.ndarray:
        number = g.column("_before")[0].as_py() + np.arange(1, g.num_rows + 1)
        return number % every == 0 if every else np.zeros(g.num_rows, bool)

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, key):
            bounds, results = steps(g.column(time).to_numpy(), gap, forced(g))
            yield pa.RecordBatch.from_arrays([g.column("_range").chunk(0)[:1], g.column(key).chunk(0)[:1], pa.array([bounds], pa.list_(pa.int64())), pa.array([results], pa.list_(pa.int64()))], names=["_range", key, "bounds", "results"])

    def carry(group: pd.DataFrame) -> pd.DataFrame:
        """A key's ranges one after the other: as many rows as ranges."""
        group = group.sort_values("_range")
        last, out = int(group["start"].iloc[0]), []
        for bounds, results in zip(group["bounds"], group["results"], strict=True):
            out.append(last)
            result = int(results[int(np.searchsorted(bounds, last, "left"))])
            last = last if result == NEVER else result
        return pd.DataFrame({"_range": group["_range"].to_numpy(), key: group[key].to_numpy(), "_carried": np.array(out, np.int64)})

    maps = by_range(numbered.select("_range", key, time, seq, "_before")).mapInArrow(functions, f"_range int, {key} {kind}, bounds array<long>, results array<long>")
    if state is not None:
        maps, start = maps.join(state, key, "left"), F.coalesce("_last", start)
    carried = maps.select("_range", key, "bounds", "results", start.alias("start")).groupBy(key).applyInPandas(carry, f"_range int, {key} {kind}, _carried long")
    asked = by_range(numbered.join(carried, ["_range", key]))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, key):
            t, f = g.column(time).to_numpy(), forced(g)
            kept = chain(pointers(t, gap, f), entry(t, g.column("_carried")[0].as_py(), gap, f))
            yield from g.select(columns).filter(pa.array(kept)).to_batches()

    return asked.mapInArrow(mark, rows.select(columns).schema)


def thin_batch(key: str, time: str, seq: str, gap: int, every: int | None = None, begun: int | None = None):
    """``thin`` of a stream whose batches follow each other in time, for ``run_available``'s ``each``.

    A batch begins with the state that the one before has left in the stream's folder and
    leaves its own, so one that is run again gives the same rows and state.
    """

    def each(batch: DataFrame, batch_id: int, folder: str) -> DataFrame:
        spark = batch.sparkSession
        path = lambda i: f"{folder}/state/batch={i}"
        kind = batch.schema[key].dataType.simpleString()
        schema = f"{key} {kind}, _last long, _number long"
        old = spark.read.schema(schema).parquet(path(batch_id - 1)) if batch_id else spark.createDataFrame([], schema)
        rows = _ranges(batch, key, time, seq)
        kept = stored(_thin(rows, key, time, seq, gap, every, None if begun is None else F.lit(begun), old), "thinned")
        # Sums and maxima by key of a few rows a key: the state, the batch's numbers and its last time kept.
        null = F.lit(None).cast("long")
        now = old.unionAll(rows.select(key, null, F.lit(1).cast("long"))).unionAll(kept.select(key, F.col(time).cast("long"), F.lit(0).cast("long")))
        now.groupBy(key).agg(F.max("_last").alias("_last"), F.sum("_number").alias("_number")).write.mode("overwrite").parquet(path(batch_id))
        delete(spark, path(batch_id - 2))
        delete(spark, rows.stored_at)
        return kept

    return each


def every_or_after(events: DataFrame, key: str, time: str, seq: str, every: int, after: int, begun: Column) -> DataFrame:
    """The events whose number is a multiple of ``every``, and all from ``after`` microseconds past
    ``begun`` on (a clock that is never set back)."""
    rows = _ranges(events, key, time, seq)
    sizes = rows.groupBy("_range", key).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", key, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_range", key).orderBy(time, seq)
    number = F.row_number().over(within) + F.col("_before")
    numbered = rows.join(sizes, ["_range", key]).withColumn("_number", number)
    return numbered.filter((F.col("_number") % every == 0) | (F.col(time) - begun >= after)).select(*events.columns)


class Thinner(StatefulProcessor):
    """A key's last time kept and its number of events."""

    def __init__(self, time: str, seq: str, gap: int, every: int | None, begun: int | None):
        self.time, self.seq, self.gap, self.every, self.begun = time, seq, gap, every, begun

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "last long, number long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last, number = self.state.get() if self.state.exists() else (NEVER if self.begun is None else self.begun, 0)
        for r in sorted((r for r in rows if r[self.time] is not None), key=lambda r: (r[self.time], r[self.seq])):
            number += 1
            if r[self.time] - last >= self.gap or (self.every and number % self.every == 0):
                last = r[self.time]
                yield r
        self.state.update((last, number))

    def close(self) -> None:
        pass


def thin_stream(events: DataFrame, key: str, time: str, seq: str, gap: int, every: int | None = None, begun: int | None = None) -> DataFrame:
    """``thin`` of a stream whose batches follow each other in time; append mode."""
    rows = events.filter(F.col(key).isNotNull())
    return rows.groupBy(key).transformWithState(Thinner(time, seq, gap, every, begun), events.schema, "Append", "None")
