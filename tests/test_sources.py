import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from concordat.operators import chunking, dedup, plan
from concordat.plans.builder import Reconciliation, reconcile
from concordat.schemas import INVENTORY, PREV_STATE
from concordat.sources import applier, listing, snapshot, tree
from concordat.streaming import events as ev


def build(root, files):
    for path, data in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(data)


def inventory_of(spark, root, node=0, exclude=()):
    rows = tree.scan_tree(spark, str(root), node, exclude)
    files = chunking.cdc_chunks(tree.read_contents(rows, str(root)), chunking.ChunkConfig(bits=8))
    none = F.array().cast(INVENTORY["chunks"].dataType)
    return rows.join(files, ["node_idx", "path"], "left").withColumn("chunks", F.coalesce("chunks", none)).select(INVENTORY.fieldNames())


def test_tree_scan(spark, tmp_path):
    build(tmp_path, {"a.txt": b"x", "d/.hidden": b"", "d/e/_f": b"yy", "skip/z": b"z"})
    os.symlink("d", tmp_path / "link")
    os.symlink("loop", tmp_path / "loop")
    got = {r.path: r for r in tree.scan_tree(spark, str(tmp_path), 2, ("skip", "skip/**")).collect()}
    assert {p: r.tp for p, r in got.items()} == {"a.txt": "F", "d": "D", "d/.hidden": "F", "d/e": "D", "d/e/_f": "F", "link": "L", "loop": "L"}
    assert got["link"].target == "d" and got["d/e/_f"].size == 2 and got["a.txt"].node_idx == 2
    empty = tmp_path / "d2"
    empty.mkdir()
    assert tree.scan_tree(spark, str(empty)).count() == 0


@pytest.mark.parametrize("bits", [4, 6, 8])
def test_chunk_invariants(bits):
    config = chunking.ChunkConfig(bits=bits, most=4)
    rng = random.Random(bits)
    data = rng.randbytes(20_000)
    sizes = chunking.chunk_sizes(data, config)
    assert sum(sizes) == len(data) and max(sizes) <= config.max_size and min(sizes) >= 1
    assert chunking.chunk_sizes(data, config) == sizes
    assert chunking.chunk_sizes(b"", config) == []
    assert chunking.chunk_sizes(b"tiny", chunking.ChunkConfig()) == [4]
    constant = chunking.chunk_sizes(b"A" * (2 * config.max_size), config)
    assert sum(constant) == 2 * config.max_size
    cut = lambda d: {d[sum(s[:i]) : sum(s[:i]) + n] for s in [chunking.chunk_sizes(d, config)] for i, n in enumerate(s)}
    if bits == 8:
        shifted = cut(b"prefix" + data)
        assert len(shifted & cut(data)) > len(sizes) // 2


def naive_edges(data, config):
    """The rolling checksum byte by byte."""
    out, start = [], 0
    while start < len(data):
        window, s1, s2 = [0] * 64, 64 * 31, 64 * 63 * 31
        end = min(len(data), start + config.max_size)
        for i in range(start, end):
            drop = window[(i - start) % 64]
            window[(i - start) % 64] = data[i]
            s1 += data[i] - drop
            s2 += s1 - 64 * (drop + 31)
            if ((s1 << 16 | s2 & 0xFFFF) & (1 << config.bits) - 1) == (1 << config.bits) - 1:
                end = i + 1
                break
        out.append(end - start)
        start = end
    return out


def test_chunks_against_the_rolling_checksum():
    rng = random.Random(1)
    for n in (1, 63, 64, 65, 3000):
        for bits in (3, 5, 8):
            config = chunking.ChunkConfig(bits=bits, most=3)
            data = rng.randbytes(n)
            assert chunking.chunk_sizes(data, config) == naive_edges(data, config)


def test_verified_replicas(spark):
    good, h = "data", hashlib.md5(b"data").hexdigest()
    rows = [(h, 0, 0, "damaged"), (h, 1, 1, good), (h, 2, 2, good), ("none", 0, 0, "x")]
    replicas = spark.createDataFrame(rows, "hash string, position int, node_idx int, data string")
    wanted = spark.createDataFrame([(h,), ("none",)], "hash string")
    read = dedup.verified_read(wanted, replicas, F.md5)
    assert [(r.hash, r.node_idx) for r in read.collect()] == [(h, 1)]
    assert [r.hash for r in dedup.unreadable(wanted, read).collect()] == ["none"]


def test_listing_files_round_trip(spark, tmp_path):
    build(tmp_path / "t", {"a.txt": b"hello" * 200, "d/b": b"", "d/c": b"x"})
    os.symlink("a.txt", tmp_path / "t" / "l")
    inv = inventory_of(spark, tmp_path / "t")
    listing.write_listing(inv, f"{tmp_path}/out")
    back = listing.parse_listing(listing.ordered_lines(spark, f"{tmp_path}/out")).drop("file")
    cols = [c for c in INVENTORY.fieldNames() if c != "node_idx"]
    assert sorted(map(str, back.select(cols).collect())) == sorted(map(str, inv.select(cols).collect()))


def test_listing_skips_what_it_cannot_read(spark):
    lines = ['{"typ":"C","hsh":"early"}', '{"typ":"F","pth":"a"}', "junk", '{"typ":"C","hsh":"h1","off":0,"len":5}', '{"typ":"Q","pth":"q"}', '{"typ":"C","hsh":"h2","off":5,"len":1}', '{"typ":"D"}', '{"typ":"L","pth":"l","tgt":"t"}']
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, seq int, value string")
    got = {r.path: r for r in listing.parse_listing(df).collect()}
    assert set(got) == {"a", "l"} and [c.hash for c in got["a"].chunks] == ["h1", "h2"] and got["l"].tp == "L" and got["a"].mode == 0


def test_snapshots(spark, tmp_path):
    path = f"{tmp_path}/state"
    assert snapshot.load(spark, path).count() == 0
    rows = [("p", "F", 420, 1, 1, 2, 3, 4, [("h", 0, 4)], None)]
    snapshot.save(spark.createDataFrame(rows, PREV_STATE), path)
    snapshot.save(snapshot.load(spark, path).withColumn("size", F.col("size") + 1), path)
    assert snapshot.load(spark, path).first().size == 5
    assert snapshot.clear(spark, path) and snapshot.load(spark, path).count() == 0
    entry = '{"tp":"SymLink","p":"a","md":1,"usr":2,"grp":3,"ct":4,"mt":5,"sz":0,"ch":[{"h":"x","of":0,"sz":1}],"tgt":"t"}'
    texts = [('{"a":' + entry + "}",), ('{"files":{"b":' + entry.replace('"p":"a",', "") + '},"timestamp":9}',)]
    got = snapshot.from_json_text(spark.createDataFrame(texts, "value string")).orderBy("path").collect()
    assert [(r.path, r.tp, r.target, r.chunks[0].hash) for r in got] == [("a", "L", "t", "x"), ("b", "L", "t", "x")]
    build(tmp_path / "profiles", {"b.profile.json": b"", "a.profile.json": b"", "x.json": b""})
    assert [r.profile for r in snapshot.list_profiles(spark, f"{tmp_path}/profiles").collect()] == ["a", "b"]


def test_two_trees_reconciled_twice(spark, tmp_path):
    a, b, state = tmp_path / "a", tmp_path / "b", f"{tmp_path}/state"
    build(a, {"same": b"s" * 2000, "only_a": b"a" * 3000, "both": b"old"})
    build(b, {"same": b"s" * 2000, "d/only_b": b"b", "both": b"newer!"})
    os.utime(a / "both", (100, 100))
    os.utime(b / "both", (200, 200))
    os.symlink("same", b / "l")

    def job():
        inv = [inventory_of(spark, a), inventory_of(spark, b)]
        return reconcile(spark, inv, "prefer-newest", state), inv

    r, _ = job()
    seen = []
    counters = r.on_event(lambda e, f: seen.append(e)).run(state)
    assert counters["conflicts_resolved"] == 1 and seen == ["started", "verified", "saved", "finished"]
    actions = r.actions().cache()
    actions.count()
    read = lambda root, n: tree.read_contents(tree.scan_tree(spark, str(root), n), str(root))
    contents = read(a, 0).unionByName(read(b, 1)).cache()
    contents.count()
    won = r.decided().select("path", F.col("winner_node").alias("node_idx")).join(contents, ["path", "node_idx"]).cache()
    won.count()
    dry = applier.apply(actions.filter("node_idx = 0"), str(a), won, dry_run=True)
    assert dry.filter("not ok").count() == 0 and not os.path.exists(a / "d")
    for n, root in enumerate((a, b)):
        assert applier.apply(actions.filter(f"node_idx = {n}"), str(root), won).filter("not ok").count() == 0
        assert applier.commit(spark, str(root)).first().failed == 0
    assert (a / "both").read_bytes() == (b / "both").read_bytes() == b"newer!"
    assert (a / "d/only_b").read_bytes() == b"b" and os.readlink(a / "l") == "same" and (b / "only_a").read_bytes() == b"a" * 3000
    again, _ = job()
    assert again.transfers().filter("trans_data").count() == 0 and again.conflicts().count() == 0
    os.unlink(a / "only_a")
    os.unlink(b / "only_a")
    gone, _ = job()
    assert [x.path for x in gone.deletes().collect()] == ["only_a"]


def test_applier_is_safe_and_idempotent(spark, tmp_path):
    kind = "op string, path string, target string, mode long, mtime long"
    rows = [("delete", "absent", None, None, None), ("mkdir", "d", None, None, None), ("mkdir", "d", None, None, None), ("delete", "../x", None, None, None), ("symlink", "s", "d", None, None)]
    got = applier.apply(spark.createDataFrame(rows, kind), str(tmp_path)).collect()
    assert {(r.path, r.ok) for r in got} == {("absent", True), ("d", True), ("../x", False), ("s", True)}
    build(tmp_path, {"left.concordat-tmp": b""})
    assert applier.clean(spark, str(tmp_path)) == 1


def small(spark, rows):
    return spark.createDataFrame([(0, p, "F", 420, 1, 1, 1, m, len(c), [(c, 0, len(c))], None) for p, m, c in rows], INVENTORY)


def test_builder_options(spark):
    a, b = small(spark, [("p", 1, "x"), ("q.log", 1, "x"), ("r", 1, "y")]), small(spark, [("p", 2, "zz"), ("r", 1, "y")])
    r = Reconciliation(spark).add_inventory(a, "left").add_inventory(b, "right").exclude("*.log")
    assert {x.path for x in r.inventory().collect()} == {"p", "r"}
    pick = lambda r: {x.path: x.winner_node for x in r.decided().filter("status = 'conflict'").collect()}
    assert pick(r) == {"p": None}
    assert pick(r.strategy("node-by-name", name="right")) == {"p": 1}
    assert pick(r.on_conflict(lambda versions: 0 if len(versions) == 2 else None)) == {"p": 0}
    assert pick(r.choices(spark.createDataFrame([(1, "p", 1)], "seq long, path string, chosen_node int"))) == {"p": 1}
    assert {(m.src_node, m.dst_node, m.bytes) for m in r.matrix().collect()} == {(1, 0, 2)}
    with pytest.raises(RuntimeError, match="conflict"):
        Reconciliation(spark).add_inventory(a).add_inventory(b).strategy("fail").run()
    Reconciliation(spark).add_inventory(a).add_inventory(b).strategy("fail").compat().run()
    with pytest.raises(RuntimeError, match="locked"):
        r.locked_by(spark.createDataFrame([("p",)], "path string")).run()
    with pytest.raises(ValueError):
        Reconciliation(spark).diff()


def test_excluded_paths_are_deleted_only_on_demand(spark):
    a = small(spark, [("p", 1, "x")])
    old = small(spark, [("p", 1, "x"), ("q.log", 1, "x"), ("gone", 1, "x")]).drop("node_idx")
    r = Reconciliation(spark).add_inventory(a).previous(old).exclude("*.log")
    assert {x.path for x in r.deletes().collect()} == {"gone"}
    assert {x.path for x in r.deletes_by("delete-excluded").deletes().collect()} == {"gone", "q.log"}
    assert r.deletes_by("no-delete").deletes().count() == 0
    with pytest.raises(RuntimeError, match="too many deletions"):
        r.deletes_by("sync", max_percent=10).verify()


def test_stream_of_resolutions_equals_batch(spark, tmp_path):
    conflicts = spark.createDataFrame([(p, [(0, 1, 1), (2, 1, 1)]) for p in "ab"], "path string, versions array<struct<node_idx:int,mtime:long,size:long>>")
    rows = [(1, "a", 7), (2, "a", 1), (3, "a", 0), (4, "z", 0), (5, "b", 0)]
    spark.createDataFrame(rows, "seq long, path string, chosen_node int").coalesce(1).write.parquet(f"{tmp_path}/choices.parquet")
    batch = {(r.path, r.winner_node) for r in ev.resolutions(spark.read.parquet(f"{tmp_path}/choices.parquet"), conflicts).collect()}
    stream = spark.readStream.schema("seq long, path string, chosen_node int").parquet(f"{tmp_path}/choices.parquet")
    got = ev.run_available(ev.resolutions(stream, conflicts), "complete", "choices")
    assert {(r.path, r.winner_node) for r in got.collect()} == batch == {("a", 2), ("b", 0)}


def test_fan_out(spark, tmp_path):
    seen = []
    sink = ev.fan_out(lambda df, i: seen.append(("a", df.count())), lambda df, i: seen.append(("b", df.count())))
    sink(spark.range(3), 0)
    assert seen == [("a", 3), ("b", 3)]


def test_chunk_targets_serve_every_place(spark):
    a = small(spark, [("p", 1, "x"), ("q", 1, "x"), ("n", 1, "new")])
    b = small(spark, [("p", 1, "x")]).withColumn("node_idx", F.lit(1))
    plan_rows = spark.createDataFrame([("q", 0, 1, True, True), ("n", 0, 1, True, True)], "path string, src_node int, dst_node int, trans_meta boolean, trans_data boolean")
    got = {(r.path, r.src_node) for r in plan.chunk_targets(a.unionByName(b), plan_rows).collect()}
    assert got == {("q", 1), ("n", 0)}


def test_watch_diffs_what_comes(spark, tmp_path):
    from concordat.streaming import watch

    drop, out = f"{tmp_path}/drop", f"{tmp_path}/out"
    small(spark, [("p", 1, "x"), ("q", 1, "y")]).write.parquet(f"{drop}/0")
    watch.watch(spark, drop, None, 2, out, available_now=True).awaitTermination()
    assert {(r.path, r.status) for r in watch.latest(spark, out).collect()} == {("p", "winner"), ("q", "winner")}
    small(spark, [("p", 1, "z")]).withColumn("node_idx", F.lit(1)).write.parquet(f"{drop}/1")
    watch.watch(spark, drop, None, 2, f"{out}2", available_now=True).awaitTermination()
    assert {(r.path, r.status) for r in watch.latest(spark, f"{out}2").collect()} == {("p", "conflict"), ("q", "winner")}
    assert watch.stop_all(spark) == 0


def test_all_byte_values_survive_reassembly(spark):
    from concordat.operators import chunking

    content = bytes(range(256)) * 40 + b"\xff\xfe\x00"
    files = spark.createDataFrame([(0, "a", content), (1, "b", content[::-1])], "node_idx int, path string, content binary")
    c = chunking.cdc_chunks(files, chunking.ChunkConfig(bits=8, most=4)).select("node_idx", "path", F.explode("chunks").alias("c"))
    places = files.join(c, ["node_idx", "path"]).select("node_idx", "path", "c.hash", "c.offset", F.expr("substring(content, cast(c.offset + 1 as int), cast(c.size as int))").alias("data"))
    replicas = places.select("hash", F.col("node_idx").alias("position"), "node_idx", "data")
    read = dedup.verified_read(places.select("hash"), replicas)
    assert dedup.unreadable(places, read).count() == 0
    assert {r.path: bytes(r.content) for r in dedup.reassemble(places, read).collect()} == {"a": content, "b": content[::-1]}
