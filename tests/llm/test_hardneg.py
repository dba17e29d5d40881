"""Hard negatives against plain loops over all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from concordat.llm.hardneg import LAST, NONE, Block, Windows, hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>, score long, row int"


def plain(rows, k=5, low=80, high=100):
    rows = [(i, n, v, at) for at, (i, n, v) in enumerate(rows) if i is not None and n is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b, strict=False))
    out = []
    for i, n, v, at in rows:
        if i % 100:
            continue
        positives = sorted((-dot(v, w), j) for j, m, w, there in rows if m == n and there != at)[:k]
        for p, j in positives:
            fits = sorted((-dot(v, w), x) for x, m, w, _ in rows if m != n and low * -p <= 100 * dot(v, w) <= high * -p)[:k]
            out += [(i, j, r, x, -p, -s) for r, (s, x) in enumerate(fits, 1)]
    return sorted(out)


def frame(spark, rows):
    made = spark.createDataFrame([(i, n, v, 1, 2) for i, n, v in rows], SCHEMA)
    return made.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vector"), "score", "row")


def random_rows(n, dim, seed, spread=1):
    g = np.random.default_rng(seed)
    length = g.integers(1, 1 + spread, n)
    return [(int(i * 10), int(g.integers(0, 4)), [float(x) for x in g.integers(-9, 20, dim) * length[i]]) for i in range(n)]


ODD = [
    (None, 1, [1.0, 2.0]), (100, None, [1.0, 2.0]), (200, 1, None), (300, 1, [1.0, None]), (400, 1, [float("nan"), 1.0]), (500, 1, [float("inf"), 1.0]),
    (600, 1, []), (700, 1, [3.0]), (800, 2, [3.0, 0.0, 4.0]), (800, 2, [3.0, 0.0, 4.0]), (800, 1, [3.0, 0.0, 4.0]), (-100, 3, [-1.0, -1.0]), (900, 9, [1.0]),
]


@pytest.mark.parametrize("rows", [random_rows(150, 6, 1), random_rows(150, 3, 2, 40), random_rows(60, 1, 3), ODD, ODD + random_rows(100, 3, 4), [(0, 0, [1.0, 1.0])] * 30 + [(7, 1, [1.0, 1.0])] * 40 + [(3, 2, [1.0, 0.0])] * 9], ids=["even", "long_and_short", "ties", "odd", "mixed", "one_vector"])
def test_all_pairs(spark, rows):
    got = hard_negatives(frame(spark, rows), F.col("id") % 100 == 0).collect()
    assert sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got) == plain(rows)


def test_empty_table(spark):
    assert hard_negatives(frame(spark, []), F.col("id") % 100 == 0).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(100, 1, [float(1 << 30), 3.0]), (1, 1, [float(1 << 30), 1.0]), (2, 2, [float(1 << 30), 0.0]), (3, 2, [float(1 << 30), 1.0])]
    got = [tuple(r) for r in hard_negatives(frame(spark, rows), F.col("id") % 100 == 0).orderBy("rank").collect()]
    assert got == [(100, 1, 1, 3, (1 << 60) + 3, (1 << 60) + 3), (100, 1, 2, 2, (1 << 60) + 3, 1 << 60)]


def test_short_buckets_are_pruned():
    block = lambda norm, n: Block(norm, np.arange(n), np.arange(n), np.ones(n, np.int64), np.full((n, 1), norm))
    w = Windows(2, False)
    w.add(Block(10.0, np.array([-1]), np.array([50]), np.array([0]), np.array([[10.0]])), np.array([1]), [(0, 0, 0)], np.array([NONE]), np.array([LAST]))
    w.begin()
    assert w.scan(block(9.0, 4)) and not w.scan(block(8.0, 4)) and w.scored == 1  # by the running kth score
    w = Windows(2, False)
    w.add(Block(10.0, np.array([-1]), np.array([50]), np.array([0]), np.array([[10.0]])), np.array([2]), [(0, 0, 0)] * 2, np.array([70, 95]), np.array([80, 99]))
    w.begin()
    assert w.scan(block(9.0, 4)) and w.scan(block(8.0, 4)) and not w.scan(block(7.0, 4)) and w.scored == 2  # by lower limits, then the kth score
    assert isinstance(w.result(), pa.RecordBatch) and w.result().num_rows == 2
