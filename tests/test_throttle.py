"""Throttles against a walk over each key's events, and streams against batches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordat.streaming import events as ev
from concordat.streaming import throttle
from concordat.streaming.throttle import NEVER, chain, entry, every_or_after, pointers, steps, thin, thin_stream

SCHEMA = "seq long, node string, t long, note string"


def walk(rows, gap, every=None, begun=None):
    out, state = [], {}
    for r in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[2], r[0])):
        last, n = state.get(r[1], (begun, 0))
        n += 1
        if last is None or r[2] - last >= gap or (every and n % every == 0):
            out.append(r)
            last = r[2]
        state[r[1]] = (last, n)
    return sorted(out)


def made(n, seed, spread):
    g = random.Random(seed)
    return [(i, g.choice(["hot"] * 8 + ["a", "b", "é"]), g.randrange(spread), "x") for i in range(n)] + [(n, None, 5, "x"), (n + 1, "a", None, "x")]


@pytest.mark.parametrize("gap,every,begun", [(1, None, None), (7, None, None), (50, None, 30), (50, 10, None), (10_000, 7, 0), (10_000, None, None)])
@pytest.mark.parametrize("spread", [40, 3000])
def test_thin_is_a_walk(spark, gap, every, begun, spread):
    rows = made(400, gap, spread)
    got = thin(spark.createDataFrame(rows, SCHEMA), "node", "t", "seq", gap, every, None if begun is None else F.lit(begun))
    assert sorted(tuple(r) for r in got.collect()) == walk(rows, gap, every, begun)


def test_steps_tell_what_a_chain_does():
    g = np.random.default_rng(3)
    for _ in range(300):
        t = np.sort(g.integers(0, 60, g.integers(1, 25)))
        gap = int(g.integers(1, 30))
        forced = g.random(len(t)) < g.choice([0, 0.1])
        bounds, results = steps(t, gap, forced)
        assert bounds == sorted(bounds)
        for carried in range(-40, int(t[-1]) + 1):
            kept = chain(pointers(t, gap, forced), entry(t, carried, gap, forced))
            result = results[int(np.searchsorted(bounds, carried, "left"))]
            assert (t[kept][-1] if kept.any() else NEVER) == result


def test_a_hot_key_is_many_tasks(spark):
    rows = spark.range(4000).select(F.col("id").alias("seq"), F.lit("hot").alias("node"), (F.col("id") * 3).alias("t"), F.lit("x").alias("note"))
    parts = throttle._ranges(rows, "node", "t", "seq").groupBy("_range").count().collect()
    assert len(parts) == 4 and max(p["count"] for p in parts) < 2000
    assert thin(rows, "node", "t", "seq", 10).count() == 1000


def test_every_or_after(spark):
    rows = made(300, 5, 1000)
    got = every_or_after(spark.createDataFrame(rows, SCHEMA), "node", "t", "seq", 10, 900, F.lit(0))
    want, n = [], {}
    for r in sorted((r for r in rows if r[1] and r[2] is not None), key=lambda r: (r[2], r[0])):
        n[r[1]] = n.get(r[1], 0) + 1
        if n[r[1]] % 10 == 0 or r[2] >= 900:
            want.append(r)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    rows = sorted((r for r in made(300, 9, 500) if r[2] is not None), key=lambda r: (r[2], r[0]))
    drop, state = f"{tmp_path}/drop", f"{tmp_path}/state"

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(drop)
        return ev.run_available(thin_stream(stream, "node", "t", "seq", 25, 20), "append", "thin", folder=state, settings=ev.ROCKSDB)

    for at in range(0, len(rows), 61):
        spark.createDataFrame(rows[at : at + 61], SCHEMA).coalesce(1).write.mode("append").parquet(drop)
        if at == 122:
            run()
    assert sorted(tuple(r) for r in run().collect()) == walk(rows, 25, 20)


def test_empty(spark):
    assert thin(spark.createDataFrame([], SCHEMA), "node", "t", "seq", 5).count() == 0


@pytest.mark.parametrize("begun", [None, 12])
def test_batches_of_a_stream_go_on_in_ranges(spark, tmp_path, begun, monkeypatch):
    monkeypatch.setattr(throttle, "RANGE_ROWS", 9)
    rows = sorted((r for r in made(250, 9, 500) if r[2] is not None), key=lambda r: (r[2], r[0]))
    drop, folder = f"{tmp_path}/drop", f"{tmp_path}/state"
    for at in range(0, len(rows), 90):
        spark.createDataFrame(rows[at : at + 90], SCHEMA).coalesce(1).write.mode("append").parquet(drop)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(drop)
        got = ev.run_available(stream, "append", "thin", folder=folder, each=throttle.thin_batch("node", "t", "seq", 25, 20, begun))
    assert sorted(tuple(r) for r in got.collect()) == walk(rows, 25, 20, begun)
    # A batch that is run again begins with the state of the one before.
    last = spark.createDataFrame(rows[180:], SCHEMA)
    again = throttle.thin_batch("node", "t", "seq", 25, 20, begun)(last, 2, folder)
    assert sorted(tuple(r) for r in again.collect()) == [r for r in walk(rows, 25, 20, begun) if r in rows[180:]]


def test_no_task_holds_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(throttle, "RANGE_ROWS", 100)
    rows = spark.range(4000).select(F.col("id").alias("seq"), F.lit("hot").alias("node"), (F.col("id") * 3).alias("t"), F.lit("x").alias("note"))
    parts = throttle._ranges(rows, "node", "t", "seq").groupBy("_range").count().collect()
    assert len(parts) >= 30 and max(p["count"] for p in parts) < 400
