"""The state of runs, nodes and files, reduced from a run's events.

``RUN_EVENT`` rows have one of ``KINDS``.  Each view is an aggregation for batches
(``run_state``, ``node_state``, ``file_state``) and a ``transformWithState`` query for
streams (``stream_runs``, ``stream_nodes``, ``stream_files``), whose last rows equal it.
Both see the same rows: an event is dealt out to the nodes, or node states of a file, that
it concerns, and a phase that starts to every node of its run, whose collection figures it
resets.  A timer of event time marks a node that has been quiet for too long.

Within a key the stream takes events by ``seq``; it expects later batches to hold later
ones, as a batch's folder does.  Nodes out of range are ignored, but their events
still make a file known.  Null runs, nodes and paths take no part; an unknown kind changes
nothing but the number of events.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RUN_EVENT = (
    "run long, seq long, ts timestamp, kind string, phase string, node_idx int, path string, operation string, from_node int, to_node int, "
    "to_nodes array<int>, size long, files long, present boolean, winner int, level string, message string"
)
PHASES = ("initializing", "collecting", "detecting conflicts", "resolving conflicts", "transferring metadata", "transferring chunks", "committing", "complete")
KINDS = (
    "phase_started", "phase_completed", "phase_changed", "progress", "node_connected", "node_connection_failed", "node_ready", "node_disconnecting", "node_stats", "file_discovered", "operation_started",
    "operation_completed", "file_sync", "file_delete", "dir_create", "conflict_detected", "conflict_resolved", "error", "log", "completed", "failed",
)
#: The pane a kind of event brings to the front.
PANES = {"conflict_detected": "conflicts", "completed": "nodes", "failed": "logs"}


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def log_records(events: DataFrame) -> DataFrame:
    """run, seq, level, message: the events that leave a log record."""
    c, text = F.col, lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    node = F.coalesce(c("node_idx").cast("string"), F.lit("?"))
    path, what = F.coalesce("path", F.lit("?")), F.coalesce("operation", F.lit("?"))
    said = {
        "phase_started": ("info", text("phase started: ", c("phase"))), "phase_completed": ("info", text("phase completed: ", c("phase"))), "phase_changed": ("info", text("phase: ", c("phase"))),
        "node_connected": ("success", text("connected: node ", node)), "node_connection_failed": ("error", text("connection failed: node ", node, ": ", F.coalesce("message", F.lit("?")))),
        "node_ready": ("success", text("ready: node ", node)), "node_disconnecting": ("info", text("disconnecting: node ", node)),
        "operation_started": ("info", text(what, " started: ", path)), "operation_completed": ("success", text(what, " completed: ", path, ", ", F.coalesce("size", F.lit(0)).cast("string"), " bytes")),
        "file_sync": ("info", text("synced: ", path)), "file_delete": ("info", text("deleted: ", path, " on node ", node)), "dir_create": ("info", text("folder created: ", path, " on node ", node)),
        "conflict_detected": ("warning", text("conflict: ", path)), "conflict_resolved": ("success", F.when(c("winner").isNotNull(), text("conflict resolved: ", path, " by node ", c("winner").cast("string"))).otherwise(text("conflict skipped: ", path))),
        "error": ("error", c("message")), "completed": ("success", F.lit("run completed")), "failed": ("error", text("run failed: ", F.coalesce("message", F.lit("?")))),
    }
    level = F.when(_is("log"), c("level"))
    message = F.when(_is("log"), c("message"))
    for kind, (grade, words) in said.items():
        level, message = level.when(_is(kind), F.lit(grade)), message.when(_is(kind), words)
    return events.filter(F.col("kind").isin("log", *said)).select("run", "seq", level.alias("level"), message.alias("message"))


def _last(when: Column, *values: Column) -> Column:
    """The values at the greatest seq among the rows that fit: partial sums stay one row a key."""
    return F.max(F.when(when, F.struct("seq", *values)))


def _pane() -> Column:
    pane = F.when(_is("phase_started") & (F.col("phase") == "collecting"), F.lit("nodes"))
    for kind, name in PANES.items():
        pane = pane.when(_is(kind), F.lit(name))
    return pane


def run_state(events: DataFrame) -> DataFrame:
    """run, n_events, phase, running, pane, n_conflicts, n_resolved, files, bytes (of the last progress), failure."""
    rows = events.filter("run IS NOT NULL").withColumn("pane", _pane())
    out = rows.groupBy("run").agg(
        F.count("*").alias("n_events"), _last(_is("phase_started", "phase_changed"), F.col("phase")).alias("p"), (F.count_if(_is("completed", "failed")) == 0).alias("running"),
        _last(F.col("pane").isNotNull(), F.col("pane")).alias("s"), F.count_if(_is("conflict_detected")).alias("n_conflicts"), F.count_if(_is("conflict_resolved")).alias("n_resolved"),
        _last(_is("progress"), F.col("files"), F.col("size")).alias("g"), _last(_is("failed"), F.col("message")).alias("f"),
    )
    return out.select("run", "n_events", F.col("p.phase").alias("phase"), "running", F.col("s.pane").alias("pane"), "n_conflicts", "n_resolved", F.col("g.files").alias("files"), F.col("g.size").alias("bytes"), F.col("f.message").alias("failure"))


def node_rows(events: DataFrame, n_nodes: int) -> DataFrame:
    """run, node_idx, seq, ts, what, phase, message, files, bytes: what concerns each node."""
    c = F.col
    row = lambda node, what, files="files": F.struct(node.cast("int").alias("node_idx"), F.lit(what).alias("what"), F.col(files).alias("files"))
    dealt = F.when(_is("node_connected", "node_ready"), F.array(row(c("node_idx"), "connected"))).when(_is("node_connection_failed"), F.array(row(c("node_idx"), "failed")))
    dealt = dealt.when(_is("node_disconnecting"), F.array(row(c("node_idx"), "disconnected"))).when(_is("node_stats"), F.array(row(c("node_idx"), "stats")))
    moved = _is("operation_completed") & (c("operation") != "delete") & (c("size") > 0)
    dealt = dealt.when(moved, F.array(row(c("from_node"), "sent"), row(c("to_node"), "received")))
    dealt = dealt.when(_is("phase_started"), F.transform(F.sequence(F.lit(0), F.lit(n_nodes - 1)), lambda i: row(i, "phase")))
    out = events.filter("run IS NOT NULL").select("run", "seq", "ts", "phase", "message", c("size").alias("bytes"), F.explode(dealt).alias("d"))
    return out.select("run", "d.node_idx", "seq", "ts", "d.what", "phase", "message", "d.files", "bytes").filter((c("node_idx") >= 0) & (c("node_idx") < n_nodes))


_NODE = "connected boolean, error string, files long, bytes long, shown_files long, shown_bytes long, files_sent long, bytes_sent long, files_received long, bytes_received long"
NODE_FIELDS = [f.split()[0] for f in _NODE.split(", ")]


def node_state(events: DataFrame, n_nodes: int) -> DataFrame:
    """run, node_idx and NODE_FIELDS: connected, the last error, the figures last known, those shown
    (since the last phase other than collecting began, none), sent and received.

    The figures shown are the last ones if they came after the first collecting that
    follows the last other phase: a bound of each run, so no run is put in order."""
    begun = events.filter(_is("phase_started") & F.col("run").isNotNull())
    collecting = F.col("phase").eqNullSafe("collecting")
    reset = begun.groupBy("run").agg(F.max(F.when(~collecting, F.col("seq"))).alias("reset"))
    since = begun.filter(collecting).join(reset, "run").filter("reset IS NULL OR seq > reset").groupBy("run").agg(F.min("seq").alias("since"))
    what = lambda *names: F.col("what").isin(*names)
    total = lambda name, values: F.coalesce(F.sum(F.when(what(name), values)), F.lit(0)).cast("long")
    out = node_rows(events, n_nodes).groupBy("run", "node_idx").agg(
        _last(what("connected", "failed", "disconnected"), (F.col("what") == "connected").alias("x")).alias("c"), _last(what("failed"), F.col("message")).alias("e"),
        _last(what("stats"), F.col("files"), F.col("bytes")).alias("s"), total("sent", F.lit(1)).alias("files_sent"), total("sent", F.col("bytes")).alias("bytes_sent"),
        total("received", F.lit(1)).alias("files_received"), total("received", F.col("bytes")).alias("bytes_received"),
    )
    shown = F.col("s.seq") > F.col("since")
    out = out.join(since, "run", "left")
    return out.select(
        "run", "node_idx", F.coalesce("c.x", F.lit(False)).alias("connected"), F.col("e.message").alias("error"), F.col("s.files").alias("files"), F.col("s.bytes").alias("bytes"),
        F.when(shown, F.col("s.files")).alias("shown_files"), F.when(shown, F.col("s.bytes")).alias("shown_bytes"), "files_sent", "bytes_sent", "files_received", "bytes_received",
    )


def quiet_nodes(events: DataFrame, n_nodes: int, seconds: int, watermark: Column) -> DataFrame:
    """run, node_idx, stalled: whether nothing has concerned the node for so long before the watermark."""
    last = node_rows(events, n_nodes).groupBy("run", "node_idx").agg(F.max("ts").alias("ts"))
    return last.select("run", "node_idx", (F.unix_millis(F.col("ts").cast("timestamp")) + seconds * 1000 <= watermark).alias("stalled"))


def file_rows(events: DataFrame) -> DataFrame:
    """run, path, seq, ts, turn, node_idx, what (a status, or conflict, started, completed)."""
    c = F.col
    row = lambda turn, node, what: F.struct(F.lit(turn).alias("turn"), node.cast("int").alias("node_idx"), (what if isinstance(what, Column) else F.lit(what)).alias("what"))
    none = F.lit(None)
    gone = F.array(row(0, none, "completed"), row(1, c("to_node"), "missing"))
    moved = F.array(row(0, none, "completed"), row(1, c("from_node"), "exists"), row(2, c("to_node"), "synced"))
    spread = F.transform(F.coalesce("to_nodes", F.array().cast("array<int>")), lambda n, i: F.struct((i + 1).cast("int").alias("turn"), n.alias("node_idx"), F.lit("pending").alias("what")))
    dealt = F.when(_is("file_discovered"), F.array(row(0, c("node_idx"), F.when(c("present"), "exists").otherwise("missing")))).when(_is("operation_started"), F.array(row(0, none, "started")))
    dealt = dealt.when(_is("operation_completed"), F.when(c("operation") == "delete", gone).otherwise(moved)).when(_is("file_delete"), F.array(row(0, c("node_idx"), "missing")))
    dealt = dealt.when(_is("file_sync"), F.concat(F.array(row(0, c("from_node"), "exists")), spread)).when(_is("conflict_detected"), F.array(row(0, none, "conflict")))
    return events.filter("run IS NOT NULL AND path IS NOT NULL").select("run", "path", "seq", "ts", F.explode(dealt).alias("d")).select("run", "path", "seq", "ts", "d.*")


_FILE = "statuses array<string>, is_conflict boolean, n_active long"
_OTHER = ("conflict", "started", "completed")


def file_state(events: DataFrame, n_nodes: int) -> DataFrame:
    """run, path, statuses (one a node), is_conflict (a conflict after the file became known), n_active
    (operations begun since the last one ended)."""
    rows = file_rows(events)
    status = ~F.col("what").isin(*_OTHER)
    last = [F.max(F.when(status & (F.col("node_idx") == i), F.struct("seq", "turn", "what")))["what"] for i in range(n_nodes)]
    out = rows.groupBy("run", "path").agg(
        F.array(*(F.coalesce(x, F.lit("unknown")) for x in last)).alias("statuses"), F.min(F.when(status, F.col("seq"))).alias("known"),
        F.max(F.when(F.col("what") == "conflict", F.col("seq"))).alias("conflict"), F.max(F.when(F.col("what") == "completed", F.col("seq"))).alias("done"),
    )
    begun = rows.filter("what = 'started'").join(out.select("run", "path", "done"), ["run", "path"]).filter("done IS NULL OR seq > done")
    active = begun.groupBy("run", "path").agg(F.count("*").alias("n"))
    out = out.join(active, ["run", "path"], "left")
    return out.select("run", "path", "statuses", F.coalesce(F.col("conflict") > F.col("known"), F.lit(False)).alias("is_conflict"), F.coalesce("n", F.lit(0)).alias("n_active"))


# Streams


class NodeReducer(StatefulProcessor):
    """A node's fields by its events, and a timer for its silence."""

    def __init__(self, quiet_seconds: int):
        self.quiet = quiet_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("node", _NODE + ", phase string, last_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = self.state.get() if self.state.exists() else None
        x = dict(zip([*NODE_FIELDS, "phase", "last_ms"], old, strict=True)) if old else dict.fromkeys([*NODE_FIELDS, "phase", "last_ms"])
        if not old:
            x |= {"connected": False, "files_sent": 0, "bytes_sent": 0, "files_received": 0, "bytes_received": 0, "last_ms": 0}
        for r in sorted(rows, key=lambda r: (r.seq, r.what)):
            x["last_ms"] = max(x["last_ms"], int(r.ts.timestamp() * 1000))
            if r.what == "phase":
                x["phase"] = r.phase
                if r.phase != "collecting":
                    x["shown_files"] = x["shown_bytes"] = None
            elif r.what == "stats":
                x["files"], x["bytes"] = r.files, r.bytes
                if x["phase"] == "collecting":
                    x["shown_files"], x["shown_bytes"] = r.files, r.bytes
            elif r.what in ("sent", "received"):
                x["files_" + r.what] += 1
                x["bytes_" + r.what] += r.bytes
            else:
                x["connected"] = r.what == "connected"
                if r.what == "failed":
                    x["error"] = r.message
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(x["last_ms"] + self.quiet)
        self.state.update(tuple(x.values()))
        yield self._row(key, x, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        x = dict(zip([*NODE_FIELDS, "phase", "last_ms"], self.state.get(), strict=True))
        yield self._row(key, x, True)

    def _row(self, key: Any, x: dict, stalled: bool) -> Row:
        return Row(run=key[0], node_idx=key[1], **{f: x[f] for f in NODE_FIELDS}, stalled=stalled)

    def close(self) -> None:
        pass


class FileReducer(StatefulProcessor):
    """A file's status on each node, its conflict and its operations under way."""

    def __init__(self, n_nodes: int):
        self.n = n_nodes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.statuses = handle.getMapState("statuses", "node_idx int", "status string")
        self.flags = handle.getValueState("flags", "known boolean, is_conflict boolean, n_active long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known, is_conflict, n_active = self.flags.get() if self.flags.exists() else (False, False, 0)
        changed = {}
        for r in sorted(rows, key=lambda r: (r.seq, r.turn)):
            if r.what == "started":
                n_active += 1
            elif r.what == "completed":
                n_active = 0
            elif r.what == "conflict":
                is_conflict = is_conflict or known
            else:
                known = True
                if r.node_idx is not None and 0 <= r.node_idx < self.n:
                    changed[r.node_idx] = r.what
        for node, status in changed.items():
            self.statuses.updateValue((node,), (status,))
        self.flags.update((known, is_conflict, n_active))
        now = dict.fromkeys(range(self.n), "unknown") | {k[0]: v[0] for k, v in self.statuses.iterator()}
        yield Row(run=key[0], path=key[1], statuses=[now[i] for i in range(self.n)], is_conflict=is_conflict, n_active=n_active)

    def close(self) -> None:
        pass


def stream_runs(events: DataFrame) -> DataFrame:
    """The rows of run_state that change with a batch (complete or update mode)."""
    return run_state(events)


def stream_nodes(events: DataFrame, n_nodes: int, quiet_seconds: int = 3600, late: str = "0 seconds") -> DataFrame:
    """node_state's rows that change, and ``stalled``; update mode."""
    rows = node_rows(events.withWatermark("ts", late), n_nodes)
    return rows.groupBy("run", "node_idx").transformWithState(NodeReducer(quiet_seconds), f"run long, node_idx int, {_NODE}, stalled boolean", "Update", "EventTime")


def stream_files(events: DataFrame, n_nodes: int) -> DataFrame:
    """file_state's rows that change; update mode."""
    return file_rows(events).groupBy("run", "path").transformWithState(FileReducer(n_nodes), f"run long, path string, {_FILE}", "Update", "None")
