"""Create-once files, the lock table under concurrent processes, and a watch that is stopped and begun again."""

import threading

import pytest
from pyspark.sql import functions as F

from concordat.operators import diff
from concordat.operators.locks import Locked, LockTable
from concordat.storage import CommitLog, create_once, names, read_text
from concordat.streaming import watch


def at_once(*calls):
    results, gate = [None] * len(calls), threading.Barrier(len(calls))

    def run(i):
        gate.wait()
        try:
            results[i] = calls[i]()
        except Exception as e:
            results[i] = e

    threads = [threading.Thread(target=run, args=(i,)) for i in range(len(calls))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    return results


def test_one_of_many_creates(spark, tmp_path):
    got = at_once(*(lambda i=i: create_once(spark, f"file://{tmp_path}/x/one", f"text {i}" * 100) for i in range(8)))
    assert sorted(got) == [False] * 7 + [True]
    assert read_text(spark, f"file://{tmp_path}/x/one") == f"text {got.index(True)}" * 100
    assert names(spark, f"file://{tmp_path}/x") == ["one"] and names(spark, f"file://{tmp_path}/none") == []


def test_commit_log(spark, tmp_path):
    log = CommitLog(spark, f"{tmp_path}/log")
    assert log.latest() == (0, {})
    assert log.commit(1, {"a": "ü"}) and log.commit(3, {"a": 3}) and not log.commit(3, {"a": 4})
    assert log.latest() == (3, {"a": 3}) and log.latest(below=3) == (1, {"a": "ü"})


def want(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def test_of_two_that_want_a_path_one_gets_it(spark, tmp_path):
    table = LockTable(spark, f"{tmp_path}/locks")
    for turn in range(3):
        got = at_once(*(lambda i=i: table.acquire(want(spark, "shared", f"own/{i}"), i, 100) for i in range(3)))
        tokens = [x for x in got if isinstance(x, str)]
        assert len(tokens) == 1 and sum(isinstance(x, Locked) for x in got) == 2, got
        assert {r.path for r in table.held().collect()} == {"shared", f"own/{got.index(tokens[0])}"}
        assert table.release(tokens[0]) and not table.release(tokens[0])
        assert table.held().count() == 0


def test_of_two_that_want_different_paths_both_get_theirs(spark, tmp_path):
    table = LockTable(spark, f"{tmp_path}/locks")
    got = at_once(*(lambda i=i: table.acquire(want(spark, f"own/{i}", f"own/{i}", None), i, 100 * i, ["n"]) for i in range(3)))
    assert all(isinstance(x, str) for x in got), got
    assert sorted((r.path, r.pid, r.started, r.nodes) for r in table.held().collect()) == [(f"own/{i}", i, 100 * i, ["n"]) for i in range(3)]
    assert table.remove_stale([1, 2], 86_501) == 2 and [h["pid"] for h in table.holders()] == [2]  # one gone, one a day old
    assert sorted(names(spark, f"{tmp_path}/locks/paths")) == [got[2]]
    with pytest.raises(Locked):
        table.acquire(want(spark, "own/2"), 5, 1)


def inventory(spark, rows):
    made = [(n, p, "F", 420, 0, 0, t, t, len(h), [(h, 0, len(h))], None) for n, p, t, h in rows]
    from concordat.schemas import INVENTORY

    return spark.createDataFrame(made, INVENTORY)


@pytest.mark.parametrize("fails", [False, True])
def test_watch_goes_on_after_a_stop(spark, tmp_path, fails, monkeypatch):
    prev = inventory(spark, [(0, f"p{i}", 1, "old") for i in range(0, 30, 2)]).drop("node_idx")
    drops = [[(i % 2, f"p{i % 30}", 10 + i, f"h{i % 3}") for i in range(k * 9, k * 9 + 25)] for k in range(4)]
    drop, out, state = f"{tmp_path}/drop", f"{tmp_path}/out", f"{tmp_path}/state"
    seen = {}
    for k, rows in enumerate(drops):
        inventory(spark, rows).coalesce(1).write.parquet(f"{drop}/{k}")
        seen |= {(n, p): (n, p, t, h) for n, p, t, h in rows}
        if fails and k == 2:  # dies after the state is written, before it is committed
            with monkeypatch.context() as m:
                m.setattr(CommitLog, "commit", lambda *a: 1 / 0)
                query = watch.watch(spark, drop, prev, 2, out, True, state, 8)
                with pytest.raises(Exception, match="division by zero"):
                    query.awaitTermination()
        watch.watch(spark, drop, prev, 2, out, True, state, 8).awaitTermination()
        want = {r.path: (r.status, r.winner_node, r.n_present) for r in diff.diff(inventory(spark, list(seen.values())), prev, 2).collect()}
        got = {r.path: (r.status, r.winner_node, r.n_present) for r in watch.latest(spark, out).collect()}
        assert got == {p: want[p] for p in got} and {p for _, p in seen} == set(got)
    assert CommitLog(spark, f"{state}/log").versions() == [1, 2, 3, 4]


def test_a_batch_reads_and_writes_only_its_buckets(spark, tmp_path):
    drop, out, state = f"{tmp_path}/drop", f"{tmp_path}/out", f"{tmp_path}/state"
    inventory(spark, [(0, f"p{i}", 1, "x") for i in range(200)]).coalesce(1).write.parquet(f"{drop}/0")
    watch.watch(spark, drop, None, 1, out, True, state, 16).awaitTermination()
    inventory(spark, [(0, "p7", 2, "y")]).coalesce(1).write.parquet(f"{drop}/1")
    watch.watch(spark, drop, None, 1, out, True, state, 16).awaitTermination()
    _, entry = CommitLog(spark, f"{state}/log").latest()
    assert sorted(entry["buckets"].values()) == [0] * 15 + [1]
    assert len([x for x in names(spark, f"{state}/seen/1") if x.startswith("bucket=")]) == 1


def test_listing_cut_anywhere(spark, tmp_path):
    from concordat.sources import listing
    from concordat.storage import changed, stored

    rows = [(0, f"some/path/{i}", i, "h" * (i % 7)) for i in range(40)]
    made = inventory(spark, rows).withColumn("chunks", F.transform(F.sequence(F.lit(0), F.col("mtime") % 9), lambda i: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("hash"), i.cast("long").alias("offset"), F.lit(1).cast("long").alias("size"))))
    listing.write_listing(made.coalesce(1).sortWithinPartitions("path"), f"{tmp_path}/listing")
    with changed(spark, {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}):
        lines = listing.ordered_lines(spark, f"{tmp_path}/listing")
        assert lines.rdd.getNumPartitions() > 20
        back = stored(listing.parse_listing(lines), "cut")
    assert sorted((r.path, [c.hash for c in r.chunks]) for r in back.collect()) == sorted((p, [f"c{j}" for j in range(i % 9 + 1)]) for _, p, i, _ in rows)


def test_counters_and_errors_reach_listeners(spark, tmp_path):
    from concordat.plans.builder import reconcile

    a = inventory(spark, [(0, "p", 1, "xx"), (0, "q", 1, "y"), (0, "r", 1, "z")])
    b = inventory(spark, [(1, "p", 2, "ww"), (1, "q", 1, "y")])
    events, progress, errors = [], {}, []
    table = LockTable(spark, f"{tmp_path}/locks")
    r = reconcile(spark, [a, b], "skip").on_event(lambda e, f: events.append(e)).on_progress(lambda phase, c: progress.update({phase: c})).on_error(lambda *e: errors.append(e)).locking(table, 1, 1)
    with pytest.raises(RuntimeError):
        other = table.acquire(want(spark, "q"), 2, 1)
        r.run()
    assert errors[-1][:2] == ("run", 1) and "locked: q" in errors[-1][2]
    table.release(other)
    r.run()
    assert progress["inventory"] == {"files": 5, "bytes": 7, "entries": 5} and progress["decided"] == {"paths": 3, "conflicts": 1}
    assert progress["transfers"]["files"] == 1 and progress["moves"] == {"chunks": 1, "bytes": 1}
    assert ("decided", 1, "p") in errors and events[-1] == "finished"
    assert table.held().count() == 0
    assert r.resolution_counts().first().asDict() == {"n_conflicts": 1, "n_resolved": 0, "n_unresolved": 1, "ready": False}
    assert [(x.path, x.next_path) for x in r.next_unresolved().collect()] == [("p", None)]
    r = reconcile(spark, [a, b]).on_conflict(lambda versions: 1)
    assert {x.path: x.winner_node for x in r.decided().collect()}["p"] == 1
