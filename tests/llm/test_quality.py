import random
import zlib

import numpy as np
import pyarrow as pa
from fixtures import documents

from concordat.llm import quality


def corpus(n=600):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ka", "to", "mi", "re", "sol") for b in ("n", "rta", "lim", "x", "deo", "u", "sta", "va")]
    docs, labels = [], []
    for i in range(n):
        toxic, kind = rng.random() < 0.15, rng.choice(["good"] * 6 + ["symbols", "capitals", "loops"])
        body = rng.choices(words, k=rng.choice([30, 80, 300]))
        if kind == "loops":
            body = [w for w in body[:6] for _ in range(20)]
        if kind == "symbols":
            body = [w + "%%%" for w in body]
        if toxic:
            for _ in range(3):
                body.insert(rng.randrange(len(body)), rng.choice(quality.INSULTS[:6]))
        text = " ".join(body) + "."
        docs.append((i, text.upper() if kind == "capitals" else text))
        if rng.random() < 0.4:
            labels.append((i, int(kind == "good"), int(toxic), kind))
    return docs, labels


def tables(spark, docs, labels):
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy_and_labeller_accuracies(spark):
    docs, labels = corpus()
    df, lf = tables(spark, docs, labels)
    scorer, q, t = quality.fit(df, lf)
    got = {r.doc_id: r for r in quality.rate(df, scorer).collect()}
    held = [r for r in labels if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 25
    assert np.mean([(got[d].p_quality >= 0.5) == g for d, g, _, _ in held]) > 0.95
    assert np.mean([(got[d].p_toxic >= 0.5) == x for d, _, x, _ in held]) > 0.9
    assert q.accuracies()[-1] > 0.95 and t.accuracies()[-1] > 0.9
    assert all(r.kept == (r.p_quality >= 0.5 and r.p_toxic < 0.5) for r in got.values())


def test_em_recovers_known_labellers():
    rng = np.random.default_rng(0)
    n = 20_000
    y = rng.random(n) < 0.7
    right = np.array([0.9, 0.8, 0.75, 0.95])
    v = np.where(rng.random((n, 4)) < right, y[:, None], ~y[:, None]).astype(int).astype(str)
    v[rng.random((n, 4)) < 0.3] = "-"
    patterns = {}
    for row in v:
        patterns["".join(row)] = patterns.get("".join(row), 0) + 1
    assert abs(quality.estimate(patterns).accuracies() - right).max() < 0.05


def test_odd_rows(spark):
    docs, labels = corpus(80)
    docs += [(900, None), (901, ""), (902, " \n"), (None, docs[0][1]), docs[0], (903, "word " * 100_000)]
    df, lf = tables(spark, docs, [*labels, (900, 1, 0, ""), (900, 0, 1, ""), (None, 1, 1, ""), (901, None, None, "")])
    got = quality.rate(df, quality.fit(df, lf)[0]).collect()
    assert len(got) == len(docs)
    assert all((r.p_quality, r.p_toxic, r.kept) == (0, 0, False) for r in got if r.doc_id in (900, 901, 902))
    assert len({r.p_quality for r in got if r.doc_id in (None, docs[0][0])}) == 1


def test_empty_tables(spark):
    docs, labels = corpus(50)
    df, lf = tables(spark, docs, labels)
    assert quality.rate(df.filter("false"), quality.fit(df.filter("false"), lf)[0]).count() == 0
    assert quality.rate(df, quality.fit(df, lf.filter("false"))[0]).count() == 50


def test_statistics_of_a_text():
    texts = ["AB cd! | ef ef", "", "x"]
    rows = [(s, n) for _, stats, words, _, _ in quality._runs(pa.array(texts)) for s, n in zip(stats, words, strict=True)]
    s = dict(zip(quality.STATISTICS, rows[0][0], strict=True))
    assert rows[0][1] == 5 and rows[1][1] == 0
    assert s["symbols"] == 1 / 14 and s["capitals"] == 2 / 8 and s["bare"] == 1 / 5 and s["loops"] == 1 / 5 and s["shouts"] == 1 / 5


def test_labelled_rows_come_first_in_a_small_sample(spark):
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}n" for i in range(300)]
    docs, labels = [], []
    for i in range(3000):
        toxic = i % 50 == 7
        body = rng.choices(words, k=40) + ["blerga"] * toxic
        rng.shuffle(body)
        docs.append((i, " ".join(body) + "."))
        if toxic or i % 50 == 8:
            labels.append((i, 1, int(toxic), ""))
    df, lf = tables(spark, docs, labels)
    known = {r[0]: r[2] for r in labels if zlib.crc32(str(r[0]).encode()) % 5}
    drawn = [r.doc_id for r in quality.draw(df, lf, 3000, 300).collect()]
    assert {d for d, t in known.items()} <= set(drawn) and 240 < len(drawn) < 360
    scorer = quality.fit(df, lf, sample=300)[0]
    got = {r.doc_id: r.p_toxic for r in quality.rate(df, scorer).collect()}
    held = [d for d, _, t, _ in labels if t and d not in known]
    assert len(held) > 5 and all(got[d] >= 0.5 for d in held)
    assert quality.seen_by_people(df, lf).max() == len(known)


def test_shares_are_alike_and_fill_the_room():
    assert quality.shares({"a": 10, "b": 1000, "c": 4000}, 500) == {"a": 1.0, "b": 0.245, "c": 0.06125}
    assert quality.shares({}, 5) == {}
