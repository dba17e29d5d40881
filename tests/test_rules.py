"""Rules filed under literals against every rule on every path."""

import random
import re

import pytest

from concordat.functions.globs import to_regex
from concordat.operators import rules as R

PIECES = ["src", "a", "b/", "/", "*", "**", "**/", "?", "[ab]", "[!a]", "[]x]", "{a,b}", ".txt", "log", "ü", "\\*", "deep/er"]


def made(n, seed):
    g = random.Random(seed)
    globs = ["".join(g.choices(PIECES, k=g.randrange(1, 6))) for _ in range(n)]
    paths = ["".join(g.choices(["src", "a", "b", "/", ".txt", "log", "ü", "x", "*", "deep/er"], k=g.randrange(1, 8))) for _ in range(150)]
    return globs, paths


@pytest.mark.parametrize("seed", range(5))
def test_a_match_has_the_literals(seed):
    globs, paths = made(300, seed)
    for glob in globs:
        for path in filter(re.compile(to_regex(glob)).search, paths):
            for kind, n, text in R.keys(glob):
                assert {"begins": path[:n] == text, "ends": path[-n:] == text if n else True, "holds": text in path, "any": True}[kind], (glob, path, text)


@pytest.mark.parametrize("globs", [None, ["*"], ["?", "[ab]*"], ["*.log", "*.log", "a*"], ["**", "a", "*/b/*"], []], ids=str)
def test_first_match(spark, globs):
    globs, paths = (globs, made(1, 3)[1]) if globs is not None else made(400, 9)
    table = [(i // 2, g, f"s{i % 7}") for i, g in enumerate(globs)] + [(None, "*", "never"), (0, None, "never")]
    got = R.strategies(spark.createDataFrame([(p, 1) for p in [*paths, *paths[:5], None]], "path string, n int"), spark.createDataFrame(table, "priority int, pattern string, strategy string"), "none").collect()
    want = {p: min(((i, s) for i, g, s in table if i is not None and g is not None and re.search(to_regex(g), p)), default=(0, "none"))[1] for p in paths}
    assert sorted((r.path, r.strategy) for r in got) == sorted(want.items())


def test_a_hundred_thousand_rules_join_by_equality(spark):
    rules = spark.range(100_000).selectExpr("id AS priority", "concat('src', id % 100, '/*/', id, '.txt') AS pattern", "concat('s', id % 3) AS strategy")
    paths = spark.range(0, 100_000, 50).selectExpr("concat('src', id % 100, '/x/', id, '.txt') AS path")
    out = R.strategies(paths, rules, "none")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert out.filter("strategy = 'none'").count() == 0 and out.count() == 2000


def test_rules_that_differ_in_a_long_literal_do_not_share_it(spark):
    rules = spark.range(100_000, 130_000).selectExpr("id AS priority", "concat('*/', id, '[0-4]*') AS pattern", "'s' AS strategy")
    shared = R.filed(rules).groupBy("kind", "length", "h").count()
    assert shared.agg({"count": "max"}).first()[0] <= 100
    paths = spark.createDataFrame([("a/1000004.txt",), ("a/1299990",), ("a/1299997",), ("b/129999",)], "path string")
    got = {r.path: r.strategy for r in R.strategies(paths, rules, "none").collect()}
    assert got == {"a/1000004.txt": "s", "a/1299990": "s", "a/1299997": "none", "b/129999": "none"}
