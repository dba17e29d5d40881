"""The reducers of run events: batch against a plain replay, streams against batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from concordat.streaming import events as ev
from concordat.streaming import reducer
from concordat.streaming.reducer import KINDS, NODE_FIELDS, PHASES, RUN_EVENT

N = 3
START = dt.datetime(2024, 5, 1)


def made(n, seed, first=0):
    g = random.Random(seed)
    out = []
    for i in range(first, first + n):
        kind = g.choice(KINDS)
        phase = g.choice(PHASES + ("collecting",) * 6)
        path, node = g.choice(["a", "b", "c", "d", None]), g.choice([0, 1, 2, 7, None])
        out.append((g.choice([1, 1, 2, None]), i, START + dt.timedelta(seconds=i), kind, phase, node, path, g.choice(["create", "update", "delete"]), g.randrange(N), g.choice([0, 1, 2, 9]), g.choice([None, [], [1, 2], [0, 5]]), g.choice([0, 5, 17]), i, g.random() < 0.5, g.choice([None, 1]), g.choice(["info", "warning"]), g.choice([None, "text"])))
    return out


def replay(rows):
    """One event after the other, as the engine's own display would."""
    runs, files = {}, {}
    for run, seq, _, kind, phase, node, path, operation, source, target, targets, size, n, present, _, _, message in sorted(rows, key=lambda r: r[1]):
        if run is None:
            continue
        x = runs.setdefault(run, {"n": 0, "phase": None, "running": True, "pane": None, "failure": None, "progress": (None, None), "nodes": {}, "stage": None, "conflicts": 0})
        x["n"] += 1
        fresh = lambda: {"connected": False, "error": None, "files": None, "bytes": None, "shown_files": None, "shown_bytes": None, "files_sent": 0, "bytes_sent": 0, "files_received": 0, "bytes_received": 0}
        at = lambda i: x["nodes"].setdefault(i, fresh()) if i is not None and i < N else fresh()  # noqa: B023, E731
        if kind in ("phase_started", "phase_changed"):
            x["phase"] = phase
        if kind == "phase_started":
            x["stage"] = phase
            for i in range(N):
                at(i)
                if phase != "collecting":
                    at(i)["shown_files"] = at(i)["shown_bytes"] = None
            if phase == "collecting":
                x["pane"] = "nodes"
        if kind in ("node_connected", "node_ready", "node_disconnecting", "node_connection_failed"):
            at(node)["connected"] = kind in ("node_connected", "node_ready")
        if kind == "node_connection_failed":
            at(node)["error"] = message
        if kind == "node_stats":
            at(node).update(files=n, bytes=size)
            if x["stage"] == "collecting":
                at(node).update(shown_files=n, shown_bytes=size)
        if kind == "progress":
            x["progress"] = (n, size)
        if kind == "operation_completed" and operation != "delete" and size > 0:
            at(source)["files_sent"] += 1
            at(source)["bytes_sent"] += size
            at(target)["files_received"] += 1
            at(target)["bytes_received"] += size
        if kind in ("completed", "failed"):
            x.update(running=False, pane="nodes" if kind == "completed" else "logs")
        if kind == "failed":
            x["failure"] = message
        if kind == "conflict_detected":
            x["conflicts"] += 1
            x["pane"] = "conflicts"
        if path is None:
            continue
        f = files.get((run, path))
        moves = {"file_discovered": [(node, "exists" if present else "missing")], "file_delete": [(node, "missing")], "file_sync": [(source, "exists")] + [(t, "pending") for t in targets or ()], "operation_completed": [(target, "missing")] if operation == "delete" else [(source, "exists"), (target, "synced")]}.get(kind, [])
        if kind not in ("file_discovered", "file_delete", "file_sync", "operation_completed", "operation_started", "conflict_detected"):
            continue
        f = files.setdefault((run, path), {"status": ["unknown"] * N, "known": False, "conflict": False, "active": 0})
        if kind == "conflict_detected":
            f["conflict"] |= f["known"]
        if kind == "operation_started":
            f["active"] += 1
        if kind == "operation_completed":
            f["active"] = 0
        for i, status in moves:
            f["known"] = True
            if i is not None and i < N:
                f["status"][i] = status
    return runs, files


def tables(rows):
    runs, files = replay(rows)
    return (
        sorted((k, x["n"], x["phase"], x["running"], x["pane"], x["conflicts"], *x["progress"], x["failure"]) for k, x in runs.items()),
        sorted((k, i, *(f[c] for c in NODE_FIELDS)) for k, x in runs.items() for i, f in x["nodes"].items()),
        sorted((*k, f["status"], f["conflict"], f["active"]) for k, f in files.items()),
    )


def frame(spark, rows):
    return spark.createDataFrame(rows, RUN_EVENT)


def collected(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


RUN = ("run", "n_events", "phase", "running", "pane", "n_conflicts", "files", "bytes", "failure")
NODE = ("run", "node_idx", *NODE_FIELDS)
FILE = ("run", "path", "statuses", "is_conflict", "n_active")


@pytest.mark.parametrize("seed", range(4))
def test_batch_is_a_replay(spark, seed):
    rows = made(600, seed)
    events = frame(spark, rows)
    runs, nodes, files = tables(rows)
    assert collected(reducer.run_state(events), *RUN) == runs
    assert collected(reducer.node_state(events, N), *NODE) == nodes
    assert collected(reducer.file_state(events, N), *FILE) == files


def test_empty(spark):
    events = frame(spark, [])
    assert reducer.run_state(events).count() == reducer.node_state(events, N).count() == reducer.file_state(events, N).count() == reducer.log_records(events).count() == 0


def test_log_records(spark):
    rows = {r.seq: (r.level, r.message) for r in reducer.log_records(frame(spark, [(1, i, START, k, "collecting", 2, "p", "create", 0, 1, [1], 7, 3, True, None, "debug", "said") for i, k in enumerate(KINDS)])).collect()}
    quiet = {KINDS.index(k) for k in ("progress", "node_stats", "file_discovered")}
    assert set(rows) == set(range(len(KINDS))) - quiet
    assert rows[KINDS.index("log")] == ("debug", "said") and rows[KINDS.index("conflict_resolved")] == ("success", "conflict skipped: p")


def test_streams_equal_batch_and_go_on_after_a_stop(spark, tmp_path):
    rows = made(500, 11)
    drop, state = f"{tmp_path}/drop", f"{tmp_path}/state"

    def run():
        stream = spark.readStream.schema(RUN_EVENT).option("maxFilesPerTrigger", 1).parquet(drop)
        nodes = ev.run_available(reducer.stream_nodes(stream, N, 4), "update", "nodes", ("run", "node_idx"), ("stalled",), f"{state}/nodes", ev.ROCKSDB)
        files = ev.run_available(reducer.stream_files(stream, N), "update", "files", ("run", "path"), (), f"{state}/files", ev.ROCKSDB)
        runs = ev.run_available(reducer.stream_runs(stream), "complete", "runs", folder=f"{state}/runs")
        return runs, nodes, files

    for at in range(0, 500, 100):
        frame(spark, rows[at : at + 100]).coalesce(1).write.mode("append").parquet(drop)
        if at in (200, 400):  # stopped after three drops, begun again after five
            runs, nodes, files = run()
            want = tables(rows[: at + 100])
            assert collected(runs, *RUN) == want[0]
            assert collected(nodes, *NODE) == want[1]
            assert collected(files, *FILE) == want[2]
    seen = frame(spark, rows)
    mark = int((START + dt.timedelta(seconds=499) - dt.datetime(1970, 1, 1)).total_seconds() * 1000)
    assert any(r.stalled for r in nodes.collect())
    assert collected(nodes, "run", "node_idx", "stalled") == collected(reducer.quiet_nodes(seen, N, 4, F.lit(mark)), "run", "node_idx", "stalled")
