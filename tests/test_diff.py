"""The diff against a direct state machine over the alignment."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concordat.operators import diff, plan, resolve
from concordat.schemas import INVENTORY, PREV_STATE


def row(path, tp="F", mode=420, mtime=100, size=10, chunks=("a",), target=None):
    return (path, tp, mode, 1000, 1000, mtime + 1, mtime, size, [(h, i * 10, 10) for i, h in enumerate(chunks)], target)


def inventory(spark, rows):
    return spark.createDataFrame([(n, *r) for n, r in rows], INVENTORY)


def prev(spark, rows):
    return spark.createDataFrame(rows, PREV_STATE)


def sig(r):
    return (r[1], r[2], r[3], r[4], tuple(r[8]))


def full(r):
    return (*sig(r), r[6], r[7], r[9])


def machine(slots, old):
    """(status, winner) of one path: slots by node, None where it is absent."""
    present = [(i, r) for i, r in enumerate(slots) if r is not None]
    values = [None if r is None else full(r) for r in slots]
    if all(v == values[0] for v in values):
        return ("none", None)
    if old is not None:
        changed = [i for i, r in present if sig(r) != sig(old)]
        if not changed:
            return ("none", None)
        return ("winner", changed[0]) if len(changed) == 1 else ("conflict", None)
    first = present[0]
    return ("winner", first[0]) if all(sig(r) == sig(first[1]) for _, r in present) else ("conflict", None)


def runs(slots):
    values = [None if r is None else full(r) for r in slots]
    return sum(i == 0 or v != values[i - 1] for i, v in enumerate(values))


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_against_the_state_machine(spark, n):
    rng = random.Random(n)
    inv, old, expected = [], [], {}
    for k in range(400):
        path = f"d{k % 7}/f{k}"
        make = lambda p=path: row(p, rng.choice("FFFDL"), rng.choice([420, 493]), rng.choice([1, 2]), rng.choice([5, 6]), rng.choice([("a",), ("a", "b"), ()]), rng.choice([None, "t"]))
        choices = [None, make(), make()]
        slots = [rng.choice(choices) for _ in range(n)]
        before = rng.choice([None, choices[1], choices[1], make()])
        if before is not None:
            old.append(before)
        if any(s is not None for s in slots):
            inv += [(i, s) for i, s in enumerate(slots) if s is not None]
            expected[path] = (*machine(slots, before), sum(s is not None for s in slots), runs(slots))
    got = diff.diff(inventory(spark, inv), prev(spark, old), n).collect()
    assert {r.path: (r.status, r.winner_node, r.n_present, r.n_versions) for r in got} == expected


CASES = [
    # (slots, previous, status, winner)
    ([row("p", mtime=1), row("p", mtime=2)], None, "winner", 0),
    ([row("p", chunks=("x",)), None], row("p"), "winner", 0),
    ([None, row("p")], row("p"), "none", None),
    ([row("p", "L", target="a"), row("p", "L", target="b")], None, "winner", 0),
    ([row("p", chunks=("x",), mtime=1), row("p", chunks=("x",), mtime=2)], row("p"), "conflict", None),
    ([row("p"), row("p")], None, "none", None),
]


@pytest.mark.parametrize(("slots", "old", "status", "winner"), CASES)
def test_known_cases(spark, slots, old, status, winner):
    inv = inventory(spark, [(i, s) for i, s in enumerate(slots) if s is not None])
    r = diff.diff(inv, prev(spark, [old] if old else []), len(slots)).first()
    assert (r.status, r.winner_node) == (status, winner)


def test_ctime_counts_only_in_compat(spark):
    a, b = row("p"), (*row("p")[:5], 999, *row("p")[6:])
    inv = inventory(spark, [(0, a), (1, b)])
    assert diff.diff(inv, None, 2).first().status == "none"
    assert diff.diff(inv, None, 2, diff.COMPAT_FULL_FIELDS).first().status == "winner"


VERSIONS = [(0, 100, 1024), (1, 200, 2048)]


@pytest.mark.parametrize(
    ("strategy", "kw", "position", "error"),
    [
        ("prefer-first", {}, 0, None), ("prefer-last", {}, 1, None), ("prefer-newest", {}, 1, None), ("prefer-oldest", {}, 0, None), ("prefer-largest", {}, 1, None), ("prefer-smallest", {}, 0, None),
        ("skip", {}, None, None), ("node-by-index", {"index": 10}, None, "index out of range"), ("node-by-index", {"index": 1}, 1, None), ("node-by-name", {"name": "node2"}, 1, None),
        ("node-by-name", {"name": "x"}, None, "unknown node"), ("interactive", {}, None, "needs a choice"), ("fail", {}, None, "conflict"),
    ],
)
def test_strategies(spark, strategy, kw, position, error):
    df = spark.createDataFrame([("p", VERSIONS)], "path string, versions array<struct<node_idx:int,mtime:long,size:long>>")
    r = resolve.resolve(df, strategy, node_names=("node1", "node2"), **kw).first()
    assert (r.winner_node, r.error) == (position, error)


def test_ties_and_positions_of_absent_nodes(spark):
    df = spark.createDataFrame([("p", [(1, 5, 7), (3, 5, 7)])], "path string, versions array<struct<node_idx:int,mtime:long,size:long>>")
    pick = lambda s: resolve.resolve(df, s).first().winner_node
    assert [pick(f"prefer-{s}") for s in ("newest", "largest", "oldest", "smallest", "first", "last")] == [3, 3, 1, 1, 1, 3]
    none = spark.createDataFrame([("p", [])], df.schema)
    assert resolve.resolve(none, "prefer-newest").first().error == "no versions"


def test_rules_first_match_wins(spark):
    df = spark.createDataFrame([(p, VERSIONS) for p in ("a.log", "a.txt", "x")], "path string, versions array<struct<node_idx:int,mtime:long,size:long>>")
    rules = (("*.log", "prefer-newest"), ("*.txt", "prefer-oldest"), ("*", "skip"))
    got = {r.path: (r.strategy, r.winner_node) for r in resolve.resolve_by_rules(df, rules, "fail").collect()}
    assert got == {"a.log": ("prefer-newest", 1), "a.txt": ("prefer-oldest", 0), "x": ("skip", None)}


def test_manual_choices(spark):
    df = spark.createDataFrame([(p, VERSIONS) for p in "abc"], "path string, versions array<struct<node_idx:int,mtime:long,size:long>>")
    choices = spark.createDataFrame([(3, "a", 0), (1, "a", 9), (2, "a", 1), (4, "b", -1), (5, "z", 0)], "seq long, path string, chosen_node int")
    assert {r.path: r.winner_node for r in resolve.manual(df, choices).collect()} == {"a": 1, "b": None, "c": None}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([None, ("a",), ("b",), ("a", "b"), ()]), min_size=3, max_size=3), min_size=1, max_size=12))
def test_applying_the_plan_leaves_nothing_to_do(spark, table):
    inv = inventory(spark, [(i, row(f"p{k}", chunks=c, size=10 * len(c))) for k, slots in enumerate(table) for i, c in enumerate(slots) if c is not None] or [(0, row("q"))])
    d = diff.diff(inv, None, 3)
    decided = plan.with_resolution(d, resolve.resolve(d.filter("status = 'conflict'"), "prefer-newest"))
    moved = plan.transfers(inv, decided, 3)
    missing = plan.missing_chunks(inv, moved)
    assert plan.unserved(missing, plan.chunk_moves(inv, missing)).count() == 0
    won = plan.winners(inv, decided).drop("node_idx").withColumn("node_idx", F.explode(F.array(*map(F.lit, range(3)))))
    rest = inv.join(decided.filter("winner_node is not null").select("path"), "path", "left_anti")
    after = rest.unionByName(won.select(rest.columns))
    assert diff.diff(after, None, 3).filter("status <> 'none'").count() == 0


def test_metadata_only_changes_never_write_content(spark):
    inv = inventory(spark, [(0, row("p", mode=493)), (1, row("p"))])
    decided = spark.createDataFrame([("p", "winner", 0)], "path string, status string, winner_node int")
    (t,) = plan.transfers(inv, decided, 2).collect()
    assert (t.trans_meta, t.trans_data) == (True, False)
    (a,) = plan.actions(plan.transfers(inv, decided, 2), spark.createDataFrame([], "path string"), inv, 2).collect()
    assert (a.op, a.node_idx) == ("touch", 1)


@pytest.mark.parametrize(("n", "total", "count", "percent", "allowed"), [(50, 0, 100, None, True), (100, 0, 100, None, True), (101, 0, 100, None, False), (50, 100, None, 50, True), (51, 100, None, 50, False), (50, 1000, 100, 10, True), (101, 1000, 100, 10, False), (100, 500, 100, 10, False)])
def test_delete_guard(spark, n, total, count, percent, allowed):
    one = lambda k: spark.range(k).selectExpr("cast(id as string) as path")
    assert plan.delete_guard(one(n), one(total), count, percent).first().allowed is allowed


def test_gates(spark):
    bad = inventory(spark, [(0, row("p", chunks=(), size=5)), (0, row("d", "D", chunks=(), size=0))])
    assert [r.path for r in plan.empty_files(bad).collect()] == ["p"]
    with pytest.raises(RuntimeError, match="files without"):
        plan.gate(plan.empty_files(bad), "files without chunks")
