"""The reconciliation as one object: inputs and options in, lazy tables out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, filters, plan, resolve, state
from ..operators.locks import LockTable
from ..schemas import INVENTORY, PREV_STATE
from ..sources import snapshot
from ..storage import delete, stored

OnEvent = Callable[[str, dict], None]


def _observed(phase: str) -> list[Column]:
    """What is counted while a phase's table is written, without a job of its own: progress, and
    number and first of what the phase could not use."""
    is_file, n = F.col("tp") == "F", F.count(F.lit(1))
    if phase == "inventory":
        lost = F.col("path").isNull()
        return [F.count_if(is_file).alias("files"), F.coalesce(F.sum(F.when(is_file, F.col("size"))), F.lit(0)).alias("bytes"), n.alias("entries"), F.count_if(lost).alias("n_invalid"), F.min(F.when(lost, F.col("node_idx"))).alias("first_invalid")]
    if phase == "decided":
        open_ = (F.col("status") == "conflict") & F.col("winner_node").isNull()
        return [n.alias("paths"), F.count_if(F.col("status") == "conflict").alias("conflicts"), F.count_if(open_).alias("n_unresolved"), F.min(F.when(open_, F.col("path"))).alias("first_unresolved")]
    if phase == "transfers":
        return [n.alias("files"), F.count_if("trans_data").alias("with_data")]
    lost = F.col("src_node").isNull()
    return [n.alias("chunks"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(lost).alias("n_unserved"), F.min(F.when(lost, F.col("hash"))).alias("first_unserved")]


class Reconciliation:
    """Reconcile inventories of N nodes.

    >>> r = Reconciliation(spark).add_inventory(a).add_inventory(b).strategy("prefer-newest")
    >>> r.transfers().show()

    Options follow intended semantics; ``compat()`` turns on the older ones:
    ctime counts in replica equality, the snapshot keeps winners only, a failing
    conflict is skipped, and an excluded path of the snapshot counts as deleted.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._nodes: list[DataFrame] = []
        self._names: list[str] = []
        self._prev: DataFrame | None = None
        self._rules: dict = {}
        self._strategy, self._strategy_args = "skip", {}
        self._path_rules: Sequence[tuple[str, str]] = ()
        self._choices: DataFrame | None = None
        self._on_conflict: Callable[[list[dict]], int | None] | None = None
        self._on_event: list[OnEvent] = []
        self._on_phase: list[OnEvent] = []
        self._compat = False
        self._dry_run = False
        self._delete_mode, self._limits = "sync", {}
        self._locks: DataFrame | None = None
        self._table: LockTable | None = None
        self._held: dict[str, DataFrame] | None = None

    # Inputs

    def add_inventory(self, rows: DataFrame | str, name: str | None = None) -> Reconciliation:
        df = self.spark.read.schema(INVENTORY).parquet(rows) if isinstance(rows, str) else rows
        i = len(self._nodes)
        self._nodes.append(df.withColumn("node_idx", F.lit(i)).select(INVENTORY.fieldNames()))
        self._names.append(name or f"node_{i + 1}")
        return self

    def previous(self, rows: DataFrame | str) -> Reconciliation:
        self._prev = snapshot.load(self.spark, rows) if isinstance(rows, str) else rows.select(PREV_STATE.fieldNames())
        return self

    # Options

    def exclude(self, *globs: str) -> Reconciliation:
        self._rules["exclude"] = (*self._rules.get("exclude", ()), *globs)
        return self

    def include(self, *globs: str) -> Reconciliation:
        self._rules["include"] = (*self._rules.get("include", ()), *globs)
        return self

    def ignore(self, *patterns: str) -> Reconciliation:
        self._rules["ignore"] = (*self._rules.get("ignore", ()), *patterns)
        return self

    def where(self, properties: filters.PropertyFilter) -> Reconciliation:
        self._rules["properties"] = properties
        return self

    def strategy(self, strategy: str, /, **args) -> Reconciliation:
        self._strategy, self._strategy_args = strategy, args
        return self

    def rules(self, *rules: tuple[str, str]) -> Reconciliation:
        self._path_rules = rules
        return self

    def choices(self, resolutions: DataFrame) -> Reconciliation:
        """Manual choices (seq, path, chosen_node); they come before the strategy."""
        self._choices = resolutions
        return self

    def on_conflict(self, choose: Callable[[list[dict]], int | None]) -> Reconciliation:
        """A function of a conflict's versions to a position or None."""
        self._on_conflict = choose
        return self

    def on_event(self, listener: OnEvent) -> Reconciliation:
        """listener(event, facts): started, verified, saved, finished, failed."""
        self._on_event.append(listener)
        return self

    def on_phase(self, listener: OnEvent) -> Reconciliation:
        """listener(event, facts): phase_started, phase_completed with what was counted while it ran, failed."""
        self._on_phase.append(listener)
        return self

    def on_progress(self, listener: Callable[[str, dict], None]) -> Reconciliation:
        """listener(phase, counters) when a phase's table has been written."""
        return self.on_phase(lambda event, facts: listener(facts["phase"], {k: v for k, v in facts.items() if k != "phase" and not k.startswith(("first_", "n_"))}) if event == "phase_completed" else None)

    def on_error(self, listener: Callable[[str, int, object], None]) -> Reconciliation:
        """listener(phase, number, first) for what a phase could not use (entries without a path, chunks
        that no node has), and for the error that ends a run."""

        def heard(event: str, facts: dict) -> None:
            if event == "failed":
                listener("run", 1, facts["error"])
            for k, n in facts.items():
                if event == "phase_completed" and k.startswith("n_") and n:
                    listener(facts["phase"], n, facts["first_" + k[2:]])

        return self.on_phase(heard)

    def compat(self, on: bool = True) -> Reconciliation:
        self._compat = on
        return self

    def dry_run(self, on: bool = True) -> Reconciliation:
        self._dry_run = on
        return self

    def deletes_by(self, mode: str = "sync", **limits) -> Reconciliation:
        self._delete_mode, self._limits = mode, limits
        return self

    def locked_by(self, locks: DataFrame) -> Reconciliation:
        self._locks = locks
        return self

    def locking(self, table: LockTable, pid: int, started: int) -> Reconciliation:
        """Hold the inventories' paths in a lock table while a run lasts."""
        self._table, self._holder = table, (pid, started)
        return self

    # Tables

    @property
    def n_nodes(self) -> int:
        return len(self._nodes)

    def raw_inventory(self) -> DataFrame:
        if not self._nodes:
            raise ValueError("no location was added")
        out = self._nodes[0]
        for df in self._nodes[1:]:
            out = out.unionByName(df)
        return out

    def inventory(self) -> DataFrame:
        return self._once("inventory", lambda: filters.retain(self.raw_inventory(), **self._rules))

    def prev(self) -> DataFrame:
        old = self._prev if self._prev is not None else self.spark.createDataFrame([], PREV_STATE)
        return old if self._compat or self._delete_mode == "delete-excluded" else filters.retain(old, **self._rules)

    def diff(self) -> DataFrame:
        fields = diff.COMPAT_FULL_FIELDS if self._compat else diff.FULL_FIELDS
        return diff.diff(self.inventory(), self.prev(), self.n_nodes, fields)

    def conflicts(self) -> DataFrame:
        return self.diff().filter("status = 'conflict'").select("path", "versions")

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """While a run lasts, a table is derived once and read back; else it stays a plan."""
        if self._held is None:
            return make()
        if name not in self._held:
            self._emit("phase_started", phase=name)
            seen = Observation(name)
            self._held[name] = stored(make().observe(seen, *_observed(name)), name)
            self._emit("phase_completed", phase=name, **seen.get)
        return self._held[name]

    def decided(self) -> DataFrame:
        return self._once("decided", self._decide)

    def _decide(self) -> DataFrame:
        """path, status, winner_node: manual choices, then the callback, then rules or the strategy."""
        d = self.diff()
        open_ = d.filter("status = 'conflict'").select("path", "versions")
        name = "skip" if self._strategy == "interactive" or (self._strategy == "fail" and self._compat) else self._strategy
        if self._path_rules:
            auto = resolve.resolve_by_rules(open_, self._path_rules, name)
        else:
            auto = resolve.resolve(open_, name, node_names=self._names, **self._strategy_args)
        picked = auto.select("path", "winner_node")
        if self._on_conflict is not None:
            choose = F.udf(_caller(self._on_conflict), "int", useArrow=True)
            own = open_.withColumn("_p", choose("versions")).select("path", F.get("versions", F.col("_p"))["node_idx"].alias("own"))
            picked = picked.join(own, "path").select("path", F.coalesce("own", "winner_node").alias("winner_node"))
        if self._choices is not None:
            hand = resolve.manual(open_, self._choices).withColumnRenamed("winner_node", "hand")
            picked = picked.join(hand, "path").select("path", F.coalesce("hand", "winner_node").alias("winner_node"))
        return plan.with_resolution(d, picked)

    def resolutions(self) -> DataFrame:
        """path, resolved: the conflicts, and whether they have a winner."""
        return self.decided().filter("status = 'conflict'").select("path", F.col("winner_node").isNotNull().alias("resolved"))

    def resolution_counts(self) -> DataFrame:
        return resolve.resolution_counts(self.resolutions())

    def next_unresolved(self) -> DataFrame:
        return resolve.next_unresolved(self.resolutions())

    def transfers(self) -> DataFrame:
        return self._once("transfers", self._transfer)

    def _transfer(self) -> DataFrame:
        fields = diff.COMPAT_FULL_FIELDS if self._compat else diff.FULL_FIELDS
        return plan.transfers(self.inventory(), self.decided(), self.n_nodes, fields)

    def missing(self) -> DataFrame:
        """Excluded files still count as holding their chunks."""
        t = self.transfers()
        needed = t.filter("trans_data").join(self.inventory().select("path", F.col("node_idx").alias("src_node"), "chunks"), ["path", "src_node"])
        owned = diff.node_chunks(self.raw_inventory()).withColumnRenamed("node_idx", "dst_node")
        return needed.select("dst_node", F.explode("chunks.hash").alias("hash")).distinct().join(owned, ["dst_node", "hash"], "left_anti")

    def moves(self) -> DataFrame:
        return self._once("moves", lambda: plan.chunk_moves(self.raw_inventory(), self.missing()))

    def matrix(self) -> DataFrame:
        return plan.transfer_matrix(self.moves())

    def deletes(self) -> DataFrame:
        if self._delete_mode == "no-delete":
            return self.spark.createDataFrame([], "path string")
        return diff.deleted_paths(self.inventory(), self.prev())

    def guard(self) -> DataFrame:
        return plan.delete_guard(self.deletes(), self.prev(), mode=self._delete_mode, **self._limits)

    def actions(self) -> DataFrame:
        return plan.actions(self.transfers(), self.deletes(), self.inventory(), self.n_nodes)

    def result(self) -> DataFrame:
        return plan.sync_result(self.decided(), self.transfers(), self.moves(), self.deletes(), self.inventory())

    def next_snapshot(self) -> DataFrame:
        return plan.next_snapshot(self.inventory(), self.decided(), self._compat)

    # Running

    def _emit(self, event: str, **facts) -> None:
        heard = {"phase_started": self._on_phase, "phase_completed": self._on_phase, "failed": self._on_event + self._on_phase}
        for listener in heard.get(event, self._on_event):
            listener(event, facts)

    def verify(self) -> None:
        """Raise unless every gate is empty."""
        if self._strategy == "fail" and not self._compat:
            plan.gate(self.decided().filter("status = 'conflict' and winner_node is null").select("path"), "conflict")
        plan.gate(plan.unserved(self.missing(), self.moves()), "chunks that no node has")
        plan.gate(plan.empty_files(plan.winners(self.inventory(), self.decided())), "files without chunks")
        guard = self.guard().first()
        if not guard["allowed"] and guard["reason"] != "mode":
            raise RuntimeError(f"too many deletions ({guard['reason']}): {guard['n_deletes']} of {guard['n_total']}")

    def run(self, snapshot_path: str | None = None) -> dict:
        """Check locks and gates, then save the next snapshot last; the counters."""
        self._held, token = {}, None
        try:
            if self._table is not None:
                token = self._table.acquire(self.inventory().select("path"), *self._holder, self._names)
            return self._run(snapshot_path)
        except Exception as e:
            self._emit("failed", error=str(e))
            raise
        finally:
            if token:
                self._table.release(token)
            for table in self._held.values():
                delete(self.spark, table.stored_at)
            self._held = None

    def _run(self, snapshot_path: str | None) -> dict:
        self._emit("started", nodes=self._names)
        if self._locks is not None:
            held = state.lock_conflicts(self.inventory().select("path").distinct(), self._locks).limit(1).collect()
            if held:
                raise RuntimeError(f"path is locked: {held[0]['path']}")
        self.verify()
        self._emit("verified")
        counters = self.result().first().asDict()
        if snapshot_path and not self._dry_run:
            snapshot.save(self.next_snapshot(), snapshot_path)
            self._emit("saved", path=snapshot_path)
        self._emit("finished", **counters)
        return counters


def _caller(choose: Callable[[list[dict]], int | None]):
    return lambda versions: choose([v.asDict() for v in versions])


def reconcile(spark: SparkSession, inventories: Sequence[DataFrame | str], strategy: str = "skip", previous: DataFrame | str | None = None) -> Reconciliation:
    out = Reconciliation(spark).strategy(strategy)
    for x in inventories:
        out.add_inventory(x)
    return out.previous(previous) if previous is not None else out
