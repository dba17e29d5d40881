import hashlib
import random
import re

import numpy as np
import pytest
from fixtures import DOCS, documents
from pyspark.sql import functions as F

from concordat.llm import fingerprint as fp


def shingles(text, k=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, got):
    """Against brute force: the edit is exact, the likeness near the true one."""
    docs = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: r[0], reverse=True)
    got = {r.doc_id: r for r in got}
    errors = []
    for i, (doc_id, text) in enumerate(docs):
        other, r, k = docs[(i + 1) % len(docs)][1], got[doc_id], len(text) // 3
        edited = text[: len(text) - k] + other[:k]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r.near_edited - jaccard(shingles(text), shingles(edited)), r.near_next - jaccard(shingles(text), shingles(other))]
        assert 0 <= r.near_edited <= 1
        if text == edited:
            assert r.fingerprint == r.edited_fingerprint
    return np.array(errors)


def unique_rows():
    rng = random.Random(4)
    rows = [r for i, r in enumerate(DOCS) if r[0] is not None and i not in (7, 9)]
    rows += [(100 + i, " ".join(rng.choices([f"w{j}" for j in range(3000)], k=rng.choice([3, 8, 40, 200, 900])))) for i in range(60)]
    rows += [(200 + i, rows[-1][1]) for i in range(3)]
    return rows


@pytest.mark.parametrize("n", ["1", "4"])
def test_against_brute_force(spark, n):
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        rows = unique_rows()
        errors = check(rows, fp.edited_fingerprints(documents(spark, rows)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(errors) == 2 * len(rows)
    assert abs(errors).max() < 0.12
    assert abs(errors.mean()) < 0.01


def test_repeated_and_null_ids_keep_every_row(spark):
    got = fp.edited_fingerprints(documents(spark)).collect()
    assert len(got) == len(DOCS)
    assert sorted(r.n_chars for r in got) == sorted(len(t or "") for _, t in DOCS)


def test_single_row_and_empty_table(spark):
    (r,) = fp.edited_fingerprints(documents(spark, [(1, "abc def")])).collect()
    assert (r.edited_sha256, r.near_next) == (hashlib.sha256(b"abc dab").hexdigest(), 1.0)
    assert fp.edited_fingerprints(documents(spark).filter("false")).count() == 0


def test_plan_has_no_python(spark):
    plan = fp.edited_fingerprints(documents(spark, unique_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def test_likeness_is_unbiased_for_few_and_many_shingles(spark):
    rng = random.Random(9)
    rows, true = [], []
    for n in [6, 12, 30, 100, 400, 2000] * 8:
        base = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        cut = rng.randrange(1, n)
        other = base[:cut] + [f"u{rng.randrange(10**6)}" for _ in range(n - cut)]
        rows.append((" ".join(base), " ".join(other)))
        true.append(jaccard(shingles(rows[-1][0]), shingles(rows[-1][1])))
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    got = [r[0] for r in df.select(fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b")))).collect()]
    errors = np.array(got) - np.array(true)
    assert abs(errors.mean()) < 0.02
    assert errors.std() < 0.05
