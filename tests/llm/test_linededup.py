import random
from itertools import combinations

import pytest
from fixtures import documents
from pyspark.sql import functions as F

from concordat.llm import linededup as ld
from concordat.llm import shared


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        prev, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, prev + (x != y))
    return row[-1]


def lines(rows):
    return [(d, i, s) for d, t in rows for i, raw in enumerate((t or "").split("\n")) if t is not None and (s := raw.strip(" \t\n\x0b\x0c\r"))]


def near(a, b):
    """The two rules, plainly."""
    x, y = a.split(" "), b.split(" ")
    chars, words = min(2, max(len(a), len(b)) // 10), max(len(x), len(y)) // 10
    if max(len(x), len(y)) < 20 and chars and abs(len(a) - len(b)) <= chars and distance(a, b) <= chars:
        return True
    return words > 0 and abs(len(x) - len(y)) <= words and distance(x, y) <= words


def brute(rows):
    all_ = lines(rows)
    texts = sorted({s for _, _, s in all_})
    root, n = {s: s for s in texts}, dict.fromkeys(texts, 0)

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for a, b in combinations(texts, 2):
        if near(a, b):
            root[find(a)] = find(b)
            n[a] += 1
            n[b] += 1
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    opens = {}
    for d, i, s in all_:
        r = find(s)
        opens[r] = min(opens.get(r, (d, i)), (d, i), key=order)
    return sorted(((d, i, len(s), *opens[find(s)], n[s], (d, i) == opens[find(s)]) for d, i, s in all_), key=repr)


def edit(rng, s, n):
    s = list(s)
    for _ in range(n):
        i, kind = rng.randrange(len(s) + 1), rng.randrange(3)
        if kind == 0:
            s.insert(i, rng.choice("abcé "))
        elif s and i < len(s):
            s[i : i + 1] = [] if kind == 1 else [rng.choice("xyzß")]
    return "".join(s).strip() or "q"


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 8)))
    rows = [(1, None), (2, ""), (3, " \n\t\n "), (4, "short\nshort\nshorty"), (None, "a line without an id, of some length"), (5, "a line without an id, of some length!")]
    for g in range(25):
        base = " ".join(word() for _ in range(rng.choice([2, 3, 4, 5, 8, 30])))
        for _ in range(rng.choice([1, 2, 5, 12])):
            picked = [edit(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 4])) for _ in range(rng.choice([1, 2]))]
            rows.append((10 + len(rows), "\n".join(picked) + rng.choice(["", "\n", " \r\n"])))
    rows += [(9000, "x" * 40_000), (9001, "x" * 20_000 + "y" + "x" * 19_999), (9002, "x" * 39_000), (9003, "y" * 40_000)]
    rows.append(rows[20])
    rng.shuffle(rows)
    return rows


def test_classes_against_brute_force(spark):
    rows = corpus()
    short = [r for r in rows if len(r[1] or "") < 5000]
    got = ld.line_classes(documents(spark, short)).drop("doc_hash").collect()
    assert sorted(map(tuple, got), key=repr) == brute(short)
    assert any(r.n_links > 3 for r in got)


def test_very_long_lines(spark):
    rows = [r for r in corpus() if len(r[1] or "") >= 5000]
    got = {r.doc_id: (r.class_doc_id, r.n_links) for r in ld.line_classes(documents(spark, rows)).collect()}
    assert got == {9000: (9000, 1), 9001: (9000, 1), 9002: (9002, 0), 9003: (9003, 0)}


def test_bit_parallel_distance_against_dynamic_programming(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choices("ab", k=rng.randrange(1, 25)))
        b = edit(rng, a, rng.randrange(0, 6)) if rng.random() < 0.7 else "".join(rng.choices("ab", k=rng.randrange(1, 25)))
        pairs.append((a, b) if len(a) <= len(b) else (b, a))
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    for most in (1, 2, 3):
        got = [r[0] for r in df.select(ld.bounded_edits(F.col("a"), F.col("b"), most)).collect()]
        assert got == [min(most + 1, distance(a, b)) for a, b in pairs]


def test_linked_lines_always_share_a_key_and_enough_parts(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choices("abe t", k=rng.choice([9, 20, 39, 400])))
        b = edit(rng, edit(rng, a, 1), 1)
        if len(b) >= 10:
            pairs.append((a, b) if len(a) <= len(b) else (b, a))
    pairs = [p for p in pairs if len(p[0]) >= 8 and distance(*p) <= 2]
    df = spark.createDataFrame(pairs, "a string, b string")
    shared = F.arrays_overlap(F.array(*ld.index_keys(ld.encoded(F.col("a")), F.char_length("a"))), F.array(*ld.probe_keys(ld.encoded(F.col("b")), F.char_length("b"))))
    near = ld.bags_near(ld.bag(F.col("a")), ld.bag(F.col("b")))
    assert df.filter(~shared | ~near | ~ld._blocks_intact(F.col("a"), F.col("b"))).count() == 0


def test_lines_go_and_clean_documents_stay(spark):
    passage = "a passage of many words that comes again " * 3
    rows = [(1, f"first\n{passage}\nshort"), (2, f"{passage.strip()}!\nother text of document two\nshort"), (3, passage), (4, None), (5, "clean\n\ntext"), (5, passage + "\nmore of it, not seen before")]
    got = {(r.doc_id, r.text): r.n_chars for r in ld.drop_repeated_lines(documents(spark, rows)).collect()}
    assert set(got) == {rows[0], (2, "other text of document two\nshort"), (4, None), (5, "clean\n\ntext"), (5, "more of it, not seen before")}
    assert got[2, "other text of document two\nshort"] == 32


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "\n")]])
def test_no_lines(spark, rows):
    assert ld.line_classes(documents(spark, rows)).count() == 0
    assert ld.drop_repeated_lines(documents(spark, rows)).count() == len(rows)


def test_plan_has_no_python(spark):
    plan = ld.line_classes(documents(spark, corpus()[:9]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def test_word_edits_against_brute_force(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgé", k=rng.randrange(2, 9))) for _ in range(300)] + [""]
    texts = []
    for g in range(60):
        base = rng.choices(words, k=[9, 10, 11, 18, 19, 20, 21, 29, 35, 36, 39, 40, 41, 60, 110][g % 15])
        for changes in (0, 1, 1, 2, 3, 4, 6, 11):
            copy = list(base)
            for _ in range(changes):
                i = rng.randrange(len(copy))
                copy[i : i + 1] = rng.choice([[], [rng.choice(words)], [copy[i], rng.choice(words)]])
            texts.append(" ".join(copy).strip())
    rows = list(enumerate(t for t in dict.fromkeys(texts) if t))
    got = ld.line_classes(documents(spark, rows)).drop("doc_hash").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    further = sum(near(a, b) and distance(a, b) > 2 for (_, a), (_, b) in combinations(rows, 2) if abs(len(a) - len(b)) < 60)
    assert further > 100


def test_words_of_one_code_are_told_apart(spark, monkeypatch):
    base = [f"w{i}" for i in range(30)]
    other = [f"x{i}" for i in range(30)]
    df = spark.createDataFrame([(" ".join(base), " ".join(other), " ".join([*base[:27], "q", "r", "s"]), " ".join([*base[:26], "q", "r", "s", "t"]))], "a string, b string, c string, d string")
    same = lambda line: F.transform(F.split(line, " "), lambda w: F.lit(7).cast("long"))
    most, one = F.lit(3), F.xxhash64
    monkeypatch.setattr(ld.F, "xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 1 else one(*c))
    code = lambda c: ld._coded(same(F.col(c)))
    got = df.select(*(ld.words_within(F.col("a"), F.col(c), code("a"), code(c), most).alias(c) for c in "abcd")).first()
    assert list(got) == [True, False, True, False]


def test_short_repeats_go_if_asked(spark):
    rows = [(1, "short\nother text of one"), (2, "short\nand more of two"), (3, "short")]
    got = {r.doc_id: r.text for r in ld.drop_repeated_lines(documents(spark, rows), shortest=0).collect()}
    assert got == {1: rows[0][1], 2: "and more of two"}


def test_a_long_text_that_loses_many_lines(spark):
    long = "\n".join(f"again {i * 7919:b} and {i * 104729:b}" if i % 2 else f"#{i * 977:x}" for i in range(8_000))
    again = "\n".join(x for x in long.split("\n") if not x.startswith("#")) + "\nthe end"
    got = {r.doc_id: r.text for r in ld.drop_repeated_lines(documents(spark, [(1, long), (2, again)])).collect()}
    assert got[2].split("\n")[-1] == "the end" and len(got[2]) < len(again) // 100


def test_extra_columns_never_clash(spark):
    df = documents(spark, [(1, "one two three"), (2, None)]).selectExpr("*", "1 as id", "2 as d", "3 as gone", "4 as _id", "5 as _hash", "6 as doc_hash", "7 as whole", "8 as `a.b`")
    out = ld.drop_repeated_lines(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_many_near_copies_take_few_links(spark, monkeypatch):
    """Of n texts that are all linked, the classes need about n links, not n * n / 2."""
    base, n = [f"w{i}" for i in range(30)], 60
    rows = [(k, " ".join([*base[: k % 30], f"x{k}", *base[k % 30 + 1 :]])) for k in range(n)]
    given, components = [], ld.components
    monkeypatch.setattr(ld, "components", lambda edges, name: given.append(edges.count()) or components(edges, name))
    assert {r.doc_id for r in ld.drop_repeated_lines(documents(spark, rows)).collect()} == {0}
    assert max(given) < 4 * n


@pytest.mark.parametrize("seed", [2, 3])
def test_classes_without_counts_are_the_same(spark, seed):
    df = documents(spark, [r for r in corpus(seed) if len(r[1] or "") < 5000])
    of = lambda counted: sorted(map(tuple, ld.line_classes(df, counted).drop("n_links").collect()), key=repr)
    assert of(False) == of(True)


def test_links_of_near_copies_are_counted_not_made(spark, monkeypatch):
    """Of n texts near a frequent one nearly all pairs are linked; most are counted without a pair."""
    rng, n = random.Random(12), 120
    base = [f"w{i}" for i in range(50)]
    texts = [" ".join(base)] * 9
    for k in range(n):
        copy = list(base)
        for _ in range(rng.choice([1, 1, 2, 2, 2, 3, 4, 7])):
            i = rng.randrange(len(copy))
            copy[i : i + 1] = rng.choice([[], [f"x{rng.randrange(30)}"], [copy[i], f"y{k}"]])
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    tried, confirm = [], ld._confirm
    monkeypatch.setattr(ld, "_confirm", lambda pairs, texts: tried.append(pairs.count()) or confirm(pairs, texts))
    got = ld.line_classes(documents(spark, rows)).drop("doc_hash").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    links = sum(near(a, b) for a, b in combinations(dict.fromkeys(texts), 2))
    assert links > n * n / 4 and sum(tried) < links / 3


def test_copies_beyond_the_threshold_are_not_all_tried(spark, monkeypatch):
    """Texts that share most keys and parities, but no link, are told apart before their lines are sent."""
    n, rows = 30, []
    for k in range(n):
        new = [f"x{k}y{i // 2}" for i in range(10)]
        rows.append((k, " ".join([*(f"w{i}" for i in range(70)), *(["p"] * 10 + new)])))
    tried, confirm = [], ld._confirm
    monkeypatch.setattr(ld, "_confirm", lambda pairs, texts: tried.append(pairs.count()) or confirm(pairs, texts))
    assert not any(near(a, b) for (_, a), (_, b) in combinations(rows, 2))
    for counted in (True, False):
        assert all(r.kept for r in ld.line_classes(documents(spark, rows), counted).collect())
    # The pairs whose links are counted, and those of the classes' last turn; in turns of pivots each key has its own.
    assert max(tried[0], tried[-1]) < n * (n - 1) / 4


def test_counts_of_words_rule_out_no_link(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)]
    pairs = []
    for _ in range(300):
        a = rng.choices(words, k=rng.choice([9, 10, 20, 35, 90, 200]))
        b = list(a)
        for _ in range(len(a) // 10):
            i = rng.randrange(len(b))
            b[i : i + 1] = rng.choice([[], [rng.choice(words)], [b[i], rng.choice(words)]])
        pairs.append((" ".join(a), " ".join(b)))
    texts = ld.texts_of(ld.lines_of(documents(spark, list(enumerate(dict.fromkeys(x for p in pairs for x in p))))))
    few = ld._counted(texts, texts)
    ids = {r.line: r.t for r in texts.collect()}
    linked = spark.createDataFrame([(ids[a], ids[b]) for a, b in pairs if near(a, b)], "a long, b long")
    near_, far = (p.join(ld._named(few, "a", "w", *ld.COUNTS), "a").join(ld._named(few, "b", "w", *ld.COUNTS), "b").filter(ld._counts_near()).count() for p in (linked, spark.createDataFrame([(ids[a], ids[d]) for (a, _), (_, d) in combinations(pairs, 2) if len(a) > 700 and len(d) > 700], "a long, b long")))
    assert near_ == linked.count() > 250 and far < 200


def test_lines_of_unwanted_texts_are_sifted_before_the_shuffle(spark, monkeypatch):
    texts = ld.texts_of(ld.lines_of(documents(spark, [(k, f"line {k} of the many that are here") for k in range(2000)])))
    wanted = texts.select("t").orderBy("line").limit(20)
    kept = {r.t for r in wanted.collect()}
    plans, real = {}, ld.materialize

    def planned(df, name, values=None):
        with shared.settings(spark, values or {}):
            plans[name] = df.select("*")._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name, values)

    monkeypatch.setattr(ld, "materialize", planned)
    with shared.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        got = ld._only(texts, wanted, "some", lambda own: own.select("t", "line"))
    assert "might_contain" in plans["some"] and {r.t for r in got.collect()} == kept
