"""The Katz model against dictionaries of n-grams, and its distributions against 1."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from concordat.llm import katz
from concordat.llm.katz import discount, score

from fixtures import DOCS, documents


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def tokens_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), 0]  # 0 ends a text


class Plain:
    def __init__(self, texts, order):
        self.order, self.counts = order, [Counter() for _ in range(order + 1)]
        self.after = {}
        for tokens in texts:
            padded = [1] * (order - 1) + tokens
            for i in range(order - 1, len(padded)):
                for n in range(1, order + 1):
                    self.counts[n][tuple(padded[i - n + 1 : i + 1])] += 1
                    self.after.setdefault(tuple(padded[i - n + 1 : i]), Counter())[padded[i]] += 1
        self.d = [None] + [discount([sum(c == r for c in self.counts[n].values()) for r in range(1, 11)]) for n in range(1, order + 1)]
        self.total = sum(self.counts[1].values())

    def seen(self, h, w):
        c = self.after[h][w]
        return float(self.d[len(h) + 1](c)) * c / sum(self.after[h].values())

    def p(self, h, w):
        if not h:
            return self.seen(h, w) if w in self.after.get(h, ()) else 1 - sum(self.seen(h, x) for x in self.after.get(h, ()))
        if h not in self.after:
            return self.p(h[1:], w)
        if w in self.after[h]:
            return self.seen(h, w)
        return (1 - sum(self.seen(h, x) for x in self.after[h])) / (1 - sum(self.p(h[1:], x) for x in self.after[h])) * self.p(h[1:], w)

    def score(self, tokens):
        padded = [1] * (self.order - 1) + tokens
        return sum(math.log10(self.p(tuple(padded[i - self.order + 1 : i]), padded[i])) for i in range(self.order - 1, len(padded)))

    def base(self, tokens):
        return sum(math.log10((self.counts[1][(w,)] + 0.5) / (self.total + 0.5 * (len(self.counts[1]) + 1))) for w in tokens)


def compare(got, rows, order):
    model = Plain([tokens_of(t) for i, t in rows if not held_out(i)], order)
    want = []
    for i, t in rows:
        tokens = tokens_of(t)
        want.append((i, held_out(i), len(tokens), sum((w,) in model.counts[1] for w in tokens), model.total, model.base(tokens), model.score(tokens)))
    key = lambda r: (str(r[0]), r[2], r[5])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:5]) == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-6) and g[6] == pytest.approx(w[6], abs=1e-6)
    return model


def run(spark, rows, order):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return [tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in score(documents(spark, rows), held, order).collect()]


def texts(n, seed):
    g = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(i, " ".join(g.choices(vocabulary, weights, k=g.randrange(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_plain_model(spark, order, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK", 200)
    rows = texts(120, order) + [(5000, "w1 w2 never seen w3"), (5001, None), (5002, ""), (None, "W1 w2 w1 w2"), (7, "w3 w3"), (7, "w3 w3")]
    model = compare(run(spark, rows, order), rows, order)
    for h in list(model.after)[:40]:  # every history's probabilities add up to 1
        assert sum(model.p(h, w) for (w,) in model.counts[1]) + model.p(h, "never seen") == pytest.approx(1, abs=1e-9)


def test_odd_documents(spark):
    rows = [(i, t) for i, t in DOCS if t is None or len(t) < 1000] + [(1000, "a a a " * 4000)]
    compare(run(spark, rows, 2), rows, 2)


def test_no_training_and_no_documents(spark):
    held = [i for i in range(100) if held_out(i)][:4]
    assert [r[3:] for r in run(spark, [(i, "a b") for i in held], 3)] == [(0, 0, 0.0, 0.0)] * 4
    assert run(spark, [], 3) == []


def test_keys_travel_whole():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 1000, np.uint64))
    for k in (keys, keys[:1], keys[:0], np.array([0, (1 << 64) - 1], np.uint64)):
        assert (katz.unpack_keys(katz.pack_keys(k)) == k).all()
    x = np.array([0.5, -1.0, np.inf])
    assert (katz.unplanes(katz.planes(x), "<f8") == x).all()
