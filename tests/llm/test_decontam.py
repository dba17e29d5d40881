import hashlib
import random
import re

import numpy as np
from fixtures import documents

from concordat.llm import decontam


def ws(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    grams = {}
    for item_id, text in items:
        w = ws(text)
        n = min(window, len(w))
        for i in range(max(1, len(w) - n + 1) if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item_id)
    for doc_id, text in docs:
        w, hit, found = ws(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if g := grams.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= g
        names = ",".join(sorted(str(x) for x in found))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "ß1", "x"]
    text = lambda n: "".join(rng.choice(["", "The-"]) + w + rng.choice([" ", ", ", ".\n"]) for w in rng.choices(vocabulary, k=n))
    items = [(i, text(n)) for i, n in enumerate([30, 10, 11, 12, 40, 9, 3, 1, 0])]
    items += [(20, items[0][1]), (20, items[0][1]), (21, None), (22, "!!"), (23, "aa aa aa aa aa aa aa aa aa aa aa aa"), (24, items[4][1] + text(5))]
    docs = [(1, None), (2, ""), (3, items[0][1].upper()), (4, "aa " * 50), (5, text(20_000)), (6, text(9) + items[1][1] + text(3)), (6, items[6][1]), (None, items[5][1] + " " + items[2][1])]
    for i in range(40):
        w = ws(items[rng.choice([0, 1, 2, 3, 4, 10, 14])][1])
        a = rng.randrange(len(w))
        part = w[a : a + rng.choice([8, 9, 10, 11, 15, 40])]
        docs.append((100 + i, text(rng.choice([0, 5, 50])) + " ".join(part) + " " + text(rng.choice([0, 5]))))
    return docs, [x for x in items if x[0] != 7]


def bench(spark, items):
    return spark.createDataFrame([(*i, 1, 2) for i in items], "item_id long, text string, doc_id int, fp int")


def test_against_brute_force(spark):
    docs, items = corpus()
    got = decontam.contamination(documents(spark, docs), bench(spark, items)).drop("uid").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items)


def test_a_frequent_one_word_item(spark):
    docs, items = corpus()
    items.append((7, "w3"))
    got = decontam.contamination(documents(spark, docs), bench(spark, items)).drop("uid").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = corpus()
    assert decontam.contamination(documents(spark).filter("false"), bench(spark, items)).count() == 0
    none = decontam.contamination(documents(spark, docs), bench(spark, items).filter("false")).drop("uid").collect()
    assert sorted(map(tuple, none), key=repr) == brute(docs, [])


def test_clean_rows_stay(spark):
    docs, items = corpus()
    left = decontam.drop_contaminated(documents(spark, docs), bench(spark, items))
    bad = {r[0] for r in brute(docs, items) if r[-1]}
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((d for d, _ in docs if d not in bad), key=repr)
    assert left.columns == documents(spark).columns


def test_winnowing_keeps_one_of_each_window():
    h = np.random.default_rng(0).integers(0, 5, 200).astype(np.uint64)
    group = np.repeat([0, 1, 2], [3, 97, 100])
    kept = set(decontam.winnow(h, group, 6).tolist())
    for i in range(195):
        if group[i] == group[i + 5]:
            least = min(h[i : i + 6])
            assert max(j for j in range(i, i + 6) if h[j] == least) in kept


def test_words_of_one_polynomial_hash_stay_apart(spark):
    from test_tokens import thue_morse

    a, b = zip(*(thue_morse(n) for n in (512, 1024, 2048, 8192)), strict=True)
    items = spark.createDataFrame([(i, w) for i, w in enumerate(a)] + [(9, " ".join(a * 3))], "item_id long, text string")
    got = decontam.contamination(documents(spark, [(i, w) for i, w in enumerate(b)] + [(9, " ".join(b * 3))]), items).collect()
    assert not any(r.contaminated for r in got)


def test_extra_columns_never_clash(spark):
    df = documents(spark, [(1, "one two three"), (2, "four five"), (None, None)]).selectExpr("*", "1 as id", "2 as d", "4 as _id", "8 as `a.b`")
    out = decontam.drop_contaminated(df, spark.createDataFrame([(1, "four five")], "item_id long, text string"))
    assert out.columns == df.columns and sorted((r.doc_id or 0, r.d, r["a.b"]) for r in out.collect()) == [(0, 2, 8), (1, 2, 8)]
