import random
import re

import pytest
from pyspark.sql import functions as F

from concordat.functions import codec, globs, labels, literals, paths
from concordat.operators import filters, reconcile, state
from concordat.sources import derived


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("*.log", ["a.log", "d/a.log"], ["a.txt", "a.log2"]),
        ("**/*.log", ["a.log", "x/y/a.log"], ["a.txt"]),
        ("test_*", ["test_a", "test_a/b"], ["a_test_"]),
        ("node_modules/**", ["node_modules/x", "node_modules/x/y"], ["node_modules", "a/node_modules/x"]),
        ("a?c", ["abc"], ["ac"]),
        ("[a-c]x", ["bx"], ["dx"]),
        ("[!a-c]x", ["dx"], ["bx"]),
        ("{a,b*}.t", ["a.t", "bcd.t"], ["c.t"]),
        (r"\*x", ["*x"], ["ax"]),
        ("a/**/b", ["a/b", "a/x/y/b"], ["ab"]),
        ("a.b", ["a.b"], ["axb"]),
    ],
)
def test_globs(spark, glob, yes, no):
    for p in yes + no:
        assert bool(re.search(globs.to_regex(glob), p)) == (p in yes)
    got = [r[0] for r in spark.createDataFrame([(p,) for p in yes + no], "p string").coalesce(1).select(globs.any_of(F.col("p"), [glob])).collect()]
    assert got == [True] * len(yes) + [False] * len(no)


def test_glob_separators_and_errors():
    assert not re.search(globs.to_regex("a/*", True), "a/b/c") and re.search(globs.to_regex("a/*"), "a/b/c")
    for bad in ("[abc", "{a,b", "a\\", "[z-a]"):
        with pytest.raises(globs.InvalidPattern):
            globs.to_regex(bad)


@pytest.mark.parametrize(("path", "excluded"), [(".concordat/x", True), ("a/b.concordat-tmp", True), (".Trash-1/x", True), ("lost+found/x", True), ("d/.DS_Store", True), (".DS_Store", True), ("a~", True), ("x/.nfs1", True), ("a.swp", True), ("a.txt", False), ("kept/x", False)])
def test_always_excluded(spark, path, excluded):
    assert one(spark, filters.is_excluded(F.lit(path))) is excluded


def test_include_beats_exclude_but_not_always(spark):
    check = lambda p: one(spark, filters.is_excluded(F.lit(p), ["*.log"], ["important.log", "x.swp"]))
    assert [check(p) for p in ("a.log", "important.log", "x.swp", "a.txt")] == [True, False, True, False]


IGNORE = ["*.log", "!important.log", "node_modules/", "target/", "/top.txt", "docs/*.md"]


@pytest.mark.parametrize(
    ("path", "is_dir", "ignored"),
    [("a.log", False, True), ("d/a.log", False, True), ("important.log", False, False), ("node_modules/x.js", False, True), ("node_modules", True, True), ("node_modules", False, False), ("a/target/b/c", False, True), ("top.txt", False, True), ("d/top.txt", False, False), ("docs/a.md", False, True), ("x/docs/a.md", False, False), ("src/main.rs", False, False)],
)
def test_ignore_files(spark, path, is_dir, ignored):
    assert one(spark, filters.is_ignored(F.lit(path), F.lit(is_dir), IGNORE)) is ignored


def test_parse_ignore():
    assert filters.parse_ignore("# c\n\n *.log \n!x\n") == ["*.log", "!x"]


def test_property_filters(spark):
    df = spark.createDataFrame([("F", 1, 10), ("F", 500, 10), ("F", 2000, 10), ("D", 0, 990), ("F", 600, 2000)], "tp string, size long, mtime long")
    count = lambda **k: df.filter(filters.PropertyFilter(**k).matches()).count()
    assert count(min_size=100, max_size=1000) == 2
    assert count(min_age=20, now=1000) == 4  # the future passes
    assert count(max_age=20, now=1000) == 2
    assert count(types=("D",)) == 1
    for bad in ({"min_size": 2, "max_size": 1}, {"min_age": 2, "max_age": 1}, {"types": ()}):
        with pytest.raises(ValueError):
            filters.PropertyFilter(**bad)


@pytest.mark.parametrize(("text", "n"), [("100", 100), ("10K", 10240), ("5M", 5 << 20), ("2G", 2 << 30), ("1t", 1 << 40), ("10k", 10240), (" 5m ", 5 << 20), ("x", None), ("", None), ("1.5K", None), ("-1", None), ("99999999999T", None)])
def test_sizes(spark, text, n):
    assert one(spark, literals.parse_size(F.lit(text))) == n


@pytest.mark.parametrize(("text", "n"), [("60s", 60), ("5m", 300), ("2h", 7200), ("7d", 604800), ("120", 120), ("5ms", None), ("d", None)])
def test_durations(spark, text, n):
    assert one(spark, literals.parse_duration(F.lit(text))) == n


def test_types_and_strategies(spark):
    assert one(spark, literals.parse_types(F.lit("File, symlink,f"))) == ["F", "L"]
    assert one(spark, literals.parse_types(F.lit("file,,"))) is None
    got = lambda s: tuple(one(spark, literals.parse_strategy(F.lit(s))))
    assert got("NEWEST") == ("prefer-newest", None, None)
    assert got("node:3") == ("node-by-index", 3, None)
    assert got("Node:Alpha") == ("node-by-name", None, "alpha")
    assert got("bogus") == (None, None, None)
    assert one(spark, literals.describe_strategy(F.lit("skip"))) == "Skip conflicted files"


def test_base64url_and_digest(spark):
    assert one(spark, codec.to_base64url(F.unhex(F.lit("fbff")))) == "-_8="
    h = codec.digest(F.lit("x"))
    assert one(spark, codec.from_base64url(codec.to_base64url(h)) == h) is True
    assert one(spark, F.length(codec.to_base64url(h))) == 44
    for bad in ("short", "a" * 43 + "+", "AAAA"):
        assert one(spark, codec.from_base64url(F.lit(bad))) is None


@pytest.mark.parametrize(
    ("line", "error", "fields"),
    [
        ("F:file.txt:420:1000:1000:1234567890:1234567890:1024", None, {"tp": "F", "path": "file.txt", "mode": 420, "size": 1024}),
        ("D:d:493:1000:1000:1:2", None, {"tp": "D", "size": 0, "mtime": 2}),
        ("L:l:511:1:1:1:2:target", None, {"target": "target", "size": 0}),
        ("L:l:511:1:1:1:2:", None, {"target": None, "tp": "L"}),
        ("C:0:1024:abc", None, {"offset": 0, "size": 1024, "hash": "abc"}),
        ("F:a:1", "too few fields", {"tp": None}),
        ("F:a:x:1:1:1:1:1", "invalid number", {"path": None}),
        ("Z:1", "unknown type", {}),
        (" D:d:493:1:1:1:2:extra ", None, {"path": "d"}),
    ],
)
def test_colon_lines(spark, line, error, fields):
    r = one(spark, codec.parse_line(F.lit(line)))
    assert r.error == error and {k: r[k] for k in fields} == fields


def test_version_messages(spark):
    assert one(spark, codec.parse_versions(F.lit("INVENTORY:2, 3"), codec.GREETING)) == [2, 3]
    assert one(spark, codec.parse_versions(F.lit("INVENTORY:"), codec.GREETING)) is None
    assert one(spark, codec.parse_versions(F.lit("CAPS:x"), codec.OFFER)) is None
    assert one(spark, codec.format_versions(F.array(F.lit(2), F.lit(3)), codec.OFFER)) == "CAPS:2,3"
    assert [tuple(one(spark, codec.parse_ready(F.lit(m)))) for m in ("READY", "READY:3", "READY:x", "NO")] == [(True, None), (True, 3), (False, None), (False, None)]


def test_paths(spark):
    safe = lambda p: one(spark, paths.is_safe(F.lit(p)))
    assert [safe(p) for p in ("a/b/c", "../x", "dir/../x", "a..b")] == [True, False, False, True]
    assert one(spark, paths.backup_path(F.lit("/data/file.txt"), "/backup", ".bak")) == "/backup/file.txt.bak"
    assert one(spark, paths.ancestors(F.lit("a/b/c"))) == ["a", "a/b"]
    assert one(spark, paths.ancestors(F.lit("a"))) == []
    rows = [r[0] for r in spark.createDataFrame([("a.txt",), ("a/b",)], "p string").orderBy(paths.sort_key(F.col("p"))).collect()]
    assert rows == ["a/b", "a.txt"]


@pytest.mark.parametrize(
    ("addresses", "expected"),
    [
        (["/x/one", "/x/two"], ["one", "two"]),
        (["/a/data", "/b/data"], ["a/data", "b/data"]),
        (["server:/backup", "/home/me"], ["server:backup", "home/me"]),
        (["a@h:/x/p", "b@h:/x/q"], ["a:p", "b:q"]),
        (["10.0.0.1:/p", "10.0.0.2:/q"], [".1:p", ".2:q"]),
        (["w1.example.com:/p", "w2.example.com:/q"], ["w1:p", "w2:q"]),
        (["/same/p", "/same/p"], ["same/p[1]", "same/p[2]"]),
    ],
)
def test_node_labels(spark, addresses, expected):
    nodes = spark.createDataFrame(list(enumerate(addresses)), "node_idx int, location string")
    assert [r.label for r in labels.node_labels(nodes).orderBy("node_idx").collect()] == expected


def test_truncate_middle(spark):
    for n in range(4, 20):
        s = "".join(random.Random(n).choices("abcdefgh", k=30))
        got = one(spark, labels.truncate_middle(F.lit(s), n))
        assert len(got.encode()) <= n and got[0] == s[0]


def test_capability_policies(spark):
    caps = derived.capabilities(spark)
    assert tuple(reconcile.least_common(caps).first()) == (False, True, True, False, 2)
    assert tuple(reconcile.best_effort(caps).first()) == (True, True, True, True, 2)
    assert tuple(reconcile.source_wins(caps, 0).first()) == (True, True, True, True, 1)
    assert tuple(reconcile.source_wins(caps, 9).first()) == tuple(reconcile.least_common(caps).first())
    none = caps.filter("false")
    assert tuple(reconcile.least_common(none).first()) == (False, False, False, False, -1)
    assert tuple(reconcile.best_effort(none).first()) == (False, True, True, False, 1)


@pytest.mark.parametrize(
    ("field", "other", "differs"),
    [("size", 999, (True, True, True, True)), ("tp", "D", (True, True, True, True)), ("uid", 999, (True, False, False, False)), ("mode", 420, (True, True, False, False)), ("mtime", 1001, (True, False, False, False)), ("mtime", 1002, (True, True, False, False)), ("mtime", 1003, (True, True, True, False))],
)
def test_metadata_pairs(spark, field, other, differs):
    base = {"tp": "F", "mode": 493, "uid": 1000, "gid": 1000, "mtime": 1000, "size": 100}
    kind = "struct<tp:string,mode:long,uid:long,gid:long,mtime:long,size:long>"
    df = spark.createDataFrame([(tuple(base.values()), tuple((base | {field: other}).values()))], f"a {kind}, b {kind}")
    got = tuple(df.select(reconcile.differs("a", "b", reconcile.preset(p))).first()[0] for p in ("strict", "smart", "relaxed", "content-only"))
    assert got == differs


def test_locks_cache_and_versions(spark):
    locks = spark.createDataFrame([("a", 1, 0, ["a"], []), ("b", 2, 100_000, ["b"], [])], "path string, pid long, started long, paths array<string>, nodes array<string>")
    live = spark.createDataFrame([(2,)], "pid long")
    left, removed = state.cleaned_locks(locks, live, 100_010)
    assert [r.path for r in left.collect()] == ["b"] and removed.first().n_removed == 1
    versions = lambda rows: state.common_version(spark.createDataFrame(rows, "node_idx int, version int")).first().version
    assert versions([(0, 2), (0, 3), (1, 3), (1, 2)]) == 3
    assert versions([(0, 2), (1, 3)]) is None
    for bad in ({"chunk_bits": 7}, {"cache_size": 0}, {"retries": 101}, {"timeout": 0}):
        with pytest.raises(ValueError):
            state.check_config(**bad)


def test_small_helpers(spark, monkeypatch):
    assert one(spark, literals.is_automatic(F.lit("interactive"))) is False
    assert one(spark, literals.allows_deletion(F.lit("no-delete"))) is False
    got = lambda m: tuple(one(spark, codec.parse_commit_response(F.lit(m))))
    assert [got(m) for m in ("OK:2:0", "OK:1:1", "OK", "ERR")] == [(True, 2, 0), (False, 1, 1), (True, None, 0), (False, None, 0)]
    assert one(spark, codec.commit_response(F.lit(2), F.lit(0))) == "OK:2:0"
    monkeypatch.setenv("HOME", "/h")
    monkeypatch.delenv("XDG_DATA_HOME", raising=False)
    assert paths.expand("~/x") == "/h/x" and paths.expand("/a") == "/a" and paths.default_trash() == "/h/.local/share/Trash/files"
    assert one(spark, paths.unique_hosts(F.array(*map(F.lit, ("b:/x", "/a:b", "me@a:/y", "b:/z"))))) == ["b", "me@a"]


def test_version_rows_past_z_and_absent_nodes(spark):
    from concordat.operators import diff

    rows = [(n, "many", 100 + n // 2) for n in range(60)] + [(1, "one", 5)]
    got = {r.path: r.letters for r in diff.version_row(spark.createDataFrame(rows, "node_idx int, path string, mtime long"), 60).collect()}
    assert got["one"] == ["-", "A"] + ["-"] * 58
    assert got["many"] == [chr(65 + n // 2) for n in range(60)]


def test_json5_states(spark):
    from concordat.sources import snapshot

    text = """// saved state
    {"a,}": {tp: 'F', md: 420, mt: 7, sz: 3, /* a // comment */ ch: [{h: "x//y", of: 0, sz: 3,},],},
     'b': {"tp": "D", "md": 493,}, // last
    }"""
    got = {r.path: (r.tp, r.mode, r.size, [c.hash for c in r.chunks or ()]) for r in snapshot.from_json_text(spark.createDataFrame([(text,)], "value string")).collect()}
    assert got == {"a,}": ("F", 420, 3, ["x//y"]), "b": ("D", 493, None, [])}
    wrapped = snapshot.from_json_text(spark.createDataFrame([('{files: {"p": {tp: "F", md: 1}}, timestamp: 5}',)], "value string")).collect()
    assert [(r.path, r.mode) for r in wrapped] == [("p", 1)]


def test_ignore_files_of_a_root(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\n")
    (tmp_path / ".npmignore").write_text("# none\nbuild/\n")
    (tmp_path / "other").write_text("*")
    assert [f.rsplit("/", 1)[1] for f in filters.find_ignore_files(spark, str(tmp_path))] == [".gitignore", ".npmignore"]
    rows = spark.createDataFrame([("a.log", False), ("keep.log", False), ("build", True), ("build/x", False), ("b", False)], "path string, d boolean")
    got = {r.path for r in rows.filter(filters.is_ignored_below(spark, str(tmp_path), F.col("path"), F.col("d"))).collect()}
    assert got == {"a.log", "build", "build/x"}
