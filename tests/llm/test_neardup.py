import random
import re
import uuid
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents

from concordat.llm import components, neardup, shared, texthash


def shingles(text, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


def brute(rows, k, threshold):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        n = len(sets[i] & sets[j])
        if n and n >= threshold * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        component = min(ids, default=None)
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, at = [(None, "a null id here"), (None, "a null id here"), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "One"), (6, "two words"), (7, "two  WORDS"), (7, "two words more")], 100
    for group in range(12):
        base = rng.choices(vocabulary, k=rng.choice([5, 30, 120, 400]))
        for _ in range(rng.choice([1, 2, 6, 30])):
            rows.append((at, edited(rng, base, rng.choice([0, 0, 1, 2, 4]))))
            at += rng.choice([1, 7])
    chain = rng.choices(vocabulary, k=100)  # each near the one before, the ends far apart
    for _ in range(12):
        rows.append((at, " ".join(chain)))
        at += 1
        chain = chain[3:] + [f"c{rng.randrange(10**6)}" for _ in range(3)]
    rows.append((at, " ".join(rng.choices(vocabulary, k=20_000))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "threshold", "bands", "size"), [(3, Fraction(85, 100), 32, 5), (5, Fraction(8, 10), 40, 4)])
def test_components_against_brute_force(spark, k, threshold, bands, size):
    rows = corpus()
    got = neardup.near_duplicates(documents(spark, rows), k, threshold, bands, size).drop("uid").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, k, threshold)


def test_pairs_of_every_turn_are_confirmed(spark):
    """Without pivots all links come from the last, exhaustive turn."""
    sets = [{1, 2, 3, 4}, {1, 2, 3, 5}, {9}, {1, 2, 3, 4, 5}]
    s = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "node long, shingles array<long>")
    hashed = [texthash.mix(np.array(sorted(x), np.uint64)) for x in sets]
    b = spark.createDataFrame([(0, i, len(x), len(x) - (x == {9}), neardup.parity(h).tolist()) for i, (x, h) in enumerate(zip(sets, hashed, strict=True))], "key long, node long, size int, common int, parity array<long>")
    for pivots in (0, 1, 2):
        found, roots = neardup.links(b, s, Fraction(3, 5), pivots)
        assert {tuple(r) for r in roots.collect()} == {(0, 0), (1, 0), (3, 0)}


def test_empty_table(spark):
    assert neardup.near_duplicates(documents(spark).filter("false"), 3, Fraction(1, 2), 4, 2).count() == 0


def test_sketch_fills_every_bin_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 20, 33, 100, 3000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        s = neardup.sketch([a, a], 160)
        assert (s != neardup.EMPTY).all() and (s[0] == s[1]).all()
    base = rng.integers(0, 2**63, 1000).astype(np.uint64)
    s = neardup.sketch([base[:800], base[200:]], 2000)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.05


def test_small_and_large_sets_get_the_same_rounds(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 5, 30)]
    a = neardup.sketch(sets, 40)
    monkeypatch.setattr(neardup, "SMALL", 0)
    assert (neardup.sketch(sets, 40) == a).all()


def test_word_hashes_follow_the_words():
    texts = ["A b a B", "x", "", None, " ", "ab", "abc d é É", "x" * 300_000, "b a"]
    for cls, pattern in ((texthash.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (texthash.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen = {}
        for w in texthash.words(pa.array(texts), cls):
            b = w.bounds()
            for i in range(w.texts):
                ws = re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), texts[w.first + i] or ""))
                assert len(ws) == b[i + 1] - b[i]
                for x, h in zip(ws, w.hash[b[i] : b[i + 1]].tolist(), strict=True):
                    assert seen.setdefault(x, h) == h
        assert len(set(seen.values())) == len(seen)


def test_few_edges_take_few_tasks_and_leave_one_table(spark, tmp_path, monkeypatch):
    """Many shuffle partitions, which nothing merges, are no reason for as many files a pass."""
    monkeypatch.setattr(shared, "scratch", lambda _, name: f"file://{tmp_path}/{name}-{uuid.uuid4().hex}")
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    with shared.settings(spark, {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        out = components.components(edges)
    assert len(out.inputFiles()) <= 2 and len(list(tmp_path.iterdir())) == 1
    assert {tuple(r) for r in out.collect()} == {(i, 0) for i in range(21)}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(5, 4), (4, 5), (9, 8), (8, 7), (1, 2)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 5, 100, 2000):
        a, b = rng.integers(0, 2**63, (2, n)).astype(np.uint64) << np.uint64(1)
        for same in (0, n // 2, n):
            other = np.concatenate([a[:same], b[same:]])
            apart = int(np.bitwise_count((neardup.parity(a) ^ neardup.parity(other)).view(np.uint64)).sum())
            assert apart <= 2 * (n - same)
            assert (apart - 2 * (n - same)) % 2 == 0


def test_words_of_one_polynomial_hash_stay_apart(spark):
    from test_tokens import thue_morse

    rows = [(2 * i + j, w) for i, n in enumerate((512, 1024, 2048, 8192)) for j, w in enumerate(thue_morse(n))]
    got = neardup.near_duplicates(documents(spark, rows), 3, Fraction(85, 100), 32, 5).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == 1 for r in got)


def test_extra_columns_never_clash(spark):
    df = documents(spark, [(1, "one two three"), (2, "one two three"), (None, None)]).selectExpr("*", "1 as id", "2 as d", "4 as _id", "8 as `a.b`")
    out = neardup.keep_one(df)
    assert out.columns == df.columns and sorted((r.doc_id or 0, r.d, r["a.b"]) for r in out.collect()) == [(0, 2, 8), (1, 2, 8)]
