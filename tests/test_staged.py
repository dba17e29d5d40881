"""Two-phase writes and the tree source, split and streamed."""

import os
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from concordat.sources import staged, tree
from concordat.streaming import events as ev

KIND = "path string, content binary, mode long, mtime long"


def files_of(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, files in os.walk(root) for f in files}


def test_staged_files_move_together(spark, tmp_path):
    rows = [(f"d{i % 5}/f{i}", bytes([i]) * i, 0o600 if i % 2 else None, 1000 + i) for i in range(50)] + [("../out", b"x", None, None), ("/abs", b"x", None, None), ("empty", None, None, None)]
    root = str(tmp_path)
    job = staged.stage(spark.createDataFrame(rows, KIND).repartition(7), root)
    assert staged.jobs(root) == [job] and not any(p.startswith(("d", "empty")) for p in files_of(root))
    got = staged.finish(spark, root, job)
    assert (got["staged"], got["failed"], got["renamed"], got["already"], got["lost"]) == (51, 2, 51, 0, 0) and got["bytes"] == sum(range(50))
    assert sorted(p for p, _ in got["errors"]) == ["../out", "/abs"]
    assert files_of(root) == {p: c or b"" for p, c, *_ in rows[:50]} | {"empty": b""} and staged.jobs(root) == []
    assert os.stat(f"{root}/d1/f11").st_mode & 0o777 == 0o600 and os.stat(f"{root}/d1/f11").st_mtime == 1011
    assert staged.finish(spark, root, job)["staged"] == 0  # nothing is recorded any more


def test_only_recorded_attempts_count(spark, tmp_path):
    root = str(tmp_path)
    writer = staged.StagedWriter({"path": root, "job": "j"})
    row = lambda p, c: Row(path=p, content=c, mode=None, mtime=None)

    def breaks():
        yield row("a", b"half")
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(breaks())
    slow, fast = writer.write(iter([row("a", b"slow"), row("b", b"slow")])), writer.write(iter([row("a", b"fast"), row("b", b"fast")]))
    assert len({slow.folder, fast.folder}) == 2 and staged.finish(spark, root, "none")["staged"] == 0
    writer.commit([fast, None])
    os.replace(f"{root}/{staged.FOLDER}/j/{fast.folder}/0", f"{root}/a")  # a former finish got so far
    got = staged.finish(spark, root, "j")
    assert files_of(root) == {"a": b"fast", "b": b"fast"} and (got["renamed"], got["already"]) == (1, 1)


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    bad = spark.range(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.lit(b"x").alias("content"), F.when(F.col("id") < 3, 1).otherwise(F.raise_error(F.lit("boom"))).cast("long").alias("mode"), F.lit(None).cast("long").alias("mtime"))
    with pytest.raises(Exception, match="boom"):
        staged.stage(bad, str(tmp_path))
    assert staged.jobs(str(tmp_path)) == [] and files_of(tmp_path) == {}


def test_one_folder_at_the_root_is_many_tasks(spark, tmp_path):
    for i in range(20):
        os.makedirs(tmp_path / "only" / f"d{i}" / "deep")
        for j in range(3):
            (tmp_path / "only" / f"d{i}" / "deep" / f"f{j}").write_bytes(b"x" * j)
    reader = tree.TreeReader({"path": str(tmp_path), "tasks": "8"})
    parts = reader.partitions()
    assert len([p for p in parts if p.deep]) == 20
    got = [r[1] for p in parts for r in reader.read(p)]
    want = sorted(os.path.relpath(os.path.join(d, x), tmp_path) for d, dirs, files in os.walk(tmp_path) for x in [*dirs, *files])
    assert sorted(got) == want
    assert sorted(r.path for r in tree.scan_tree(spark, str(tmp_path)).collect()) == want
    assert {r.path for r in tree.scan_tree(spark, str(tmp_path), exclude=("only/d1*",)).collect()} == {p for p in want if not p.startswith("only/d1")}
    with pytest.raises(Exception, match="No such file"):
        tree.scan_tree(spark, str(tmp_path / "none")).collect()


def test_a_second_trigger_tells_only_changes(spark, tmp_path):
    root, state = tmp_path / "root", f"{tmp_path}/state"
    os.makedirs(root / "a" / "b")
    (root / "a" / "x").write_bytes(b"1")
    (root / "y").write_bytes(b"1")

    def run(before):
        time.sleep(1.2)
        rows = ev.run_available(tree.watch_tree(spark, str(root)), "append", "tree", folder=state)
        got = sorted(r.path for r in rows.collect())
        for p in before:
            got.remove(p)
        return got

    first = run([])
    assert first == ["a", "a/b", "a/x", "y"]
    assert run(first) == []
    (root / "a" / "b" / "new").write_bytes(b"2")
    os.chmod(root / "y", 0o600)
    assert run(first) == ["a/b", "a/b/new", "y"]
