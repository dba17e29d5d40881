import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
from fixtures import documents

from concordat.llm import langid

PIECES = [b" ", b" th", b"th", b"the", b" the", b"he", b"e", "é".encode(), b"ab", b" ab", b"ba"]


def segmentations(word, known):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in known:
            for rest in segmentations(word[k:], known):
                yield [word[:k], *rest]


def model(probability=None, languages=("x", "y")):
    p = langid.Pieces(PIECES)
    rng = np.random.default_rng(0)
    q = rng.random((len(p.pieces), len(languages)))
    q[0] = 0
    return langid.Model(list(languages), p, q / q.sum(axis=0) if probability is None else probability)


def test_forward_sums_all_segmentations():
    m = model()
    number = {b: i for i, b in enumerate(m.pieces.pieces) if i}
    words = [b" the", b" thehe", b" ab", b" abab", " thé".encode(), b" q"]
    got = langid.forward(m.pieces, words, m.probability)
    for w, row in zip(words, got, strict=True):
        for lang in range(2):
            total = sum(math.prod(m.probability[number[p], lang] for p in s) for s in segmentations(w, number))
            assert math.isclose(math.log(total), row[lang], rel_tol=1e-9)


def test_expected_counts_are_posterior_counts():
    m = model()
    number = {b: i for i, b in enumerate(m.pieces.pieces) if i}
    words, n = [b" the", b" abab"], np.array([3.0, 2.0])
    p = m.probability[:, 0]
    expected = np.zeros(len(p))
    for w, c in zip(words, n, strict=True):
        all_ = list(segmentations(w, number))
        mass = [math.prod(p[number[x]] for x in s) for s in all_]
        for s, q in zip(all_, mass, strict=True):
            for x in s:
                expected[number[x]] += c * q / sum(mass)
    assert np.allclose(langid.expected_counts(m.pieces, words, n, p), expected)


def test_totals_are_sums_over_whole_words(monkeypatch):
    monkeypatch.setattr(langid, "MOST_WORDS", 3)
    m = model()
    texts = ["the ab", None, "", "12 -- !", "— ·", "The THE thé", "q" * 95, "ab\nab the, q1q", "漢字"]
    for _ in range(3):
        rows = [(t, h) for totals, has in m.totals(pa.array(texts)) for t, h in zip(totals, has, strict=True)]
        for text, (total, has) in zip(texts, rows, strict=True):
            low = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode()
            runs = [bytes(g) for k, g in itertools.groupby(low, lambda b: bool(langid.LETTERS[b])) if k]
            parts = [b" " + r for r in runs]
            expected = langid.forward(m.pieces, parts, m.probability).sum(axis=0) if parts else np.zeros(2)
            assert np.allclose(total, expected, rtol=1e-5)
            assert has == any(c.isalpha() for c in text or "")


def corpus():
    rng = random.Random(2)
    syllables = {"aa": ["ka", "to", "mi", "ré"], "bb": ["sch", "ung", "keit", "ö"], "cc": ["tion", "ing", "the", "es"]}
    rows = []
    for i in range(240):
        lang = rng.choice(sorted(syllables))
        text = " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(rng.choice([3, 20, 100])))
        rows.append((i, text, lang))
    return rows + [(900, None, "aa"), (901, "", "bb"), (902, " 12 ?! ", "cc"), (903, "tokami", None), (None, "keitung", "bb"), (904, "x" * 200_000, "cc"), (905, "A B C", None), (905, "tion", None)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")


def test_held_out_accuracy(spark):
    rows = corpus()
    df = table(spark, rows)
    m = langid.train(df.filter(~langid.held_out()), langid.vocabulary_path())
    got = langid.predict(df.select("doc_id", "text", langid.held_out().alias("held_out"), "lang"), m, ["doc_id", "held_out", "lang"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    named = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert len(named) > 20 and all(r.lang_pred == r.lang for r in named)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {900, 901, 902}


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = corpus()
    other = [(d, t, "zz" if d is None or zlib.crc32(str(d).encode()) % 5 == 0 else lang) for d, t, lang in rows]
    a, b = (langid.train(table(spark, x).filter(~langid.held_out()), langid.vocabulary_path()) for x in (rows, other))
    assert a.languages == b.languages and np.allclose(a.probability, b.probability)


def test_nothing_to_learn_from_and_empty_table(spark):
    rows = [(d, t, None) for d, t, _ in corpus()[:5]]
    df = table(spark, rows)
    m = langid.train(df, langid.vocabulary_path())
    assert {r.lang_pred for r in langid.predict(df, m, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(df.filter("false"), m, ["doc_id"]).count() == 0


def test_filter_keeps_columns_and_clean_rows(spark):
    df = documents(spark, [(i, f"some clean words of text number {'abcdefgh'[i % 8]}") for i in range(40)] + [(50, "12 34"), (51, None)])
    kept = langid.known_languages(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(range(40))


def plain_forward(word, number, p):
    sums = [1.0] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        sums[j] = sum(sums[j - k] * p[number[word[j - k : j]]] for k in range(1, j + 1) if word[j - k : j] in number)
    return sums


def test_long_runs_sum_all_segmentations():
    m = model()
    number = {b: i for i, b in enumerate(m.pieces.pieces) if i}
    rng = random.Random(3)
    words = [b" " + "".join(rng.choice(["the", "th", "e", "ab", "b", "é"]) for _ in range(n)).encode() for n in (40, 90, 90, 7, 61, 33)]
    for block in (512, 7):
        got = langid.forward_long(m.pieces, words, m.probability, block)
        for word, row in zip(words, got, strict=True):
            for lang in range(2):
                assert math.isclose(row[lang], math.log(plain_forward(word, number, m.probability[:, lang])[-1]), rel_tol=1e-9)
    assert np.allclose(got, langid.forward(m.pieces, words, m.probability))
    # Past the range of plain numbers the sums stay finite.
    assert np.isfinite(langid.forward_long(m.pieces, [b" " + b"q" * 5000], m.probability)).all()


def test_long_runs_count_as_short_ones_do(monkeypatch):
    m, p = model(), model().probability[:, 0]
    word = b" thetheabab" * 5
    assert np.allclose(langid.expected_long(m.pieces, word, 2.0, p), langid.expected_counts(m.pieces, [word], np.array([2.0]), p))
    monkeypatch.setattr(langid, "FIT_BYTES", 9)
    parts = langid._parts("漢字漢字漢字the".encode())
    assert b"".join(parts) == "漢字漢字漢字the".encode() and all(x.decode() and len(x) <= 9 for x in parts)


def test_query_equals_brute_force(spark):
    """The whole prediction, written plainly for one fitted model."""
    df = documents(spark)
    m = langid.Model(["x", "y"], *(lambda q: (q.pieces, q.probability))(model()))
    number = {b: i for i, b in enumerate(m.pieces.pieces) if i}
    got = {(r.doc_id, r.text): r for r in langid.predict(df, m, ["doc_id", "text"]).collect()}
    for doc_id, text in {(r.doc_id, r.text) for r in df.collect()}:
        if text and len(text) > 5000:
            continue
        low = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode()
        logs = [sum(math.log(plain_forward(b" " + bytes(g), number, m.probability[:, i])[-1]) for k, g in itertools.groupby(low, lambda b: bool(langid.LETTERS[b])) if k) for i in range(2)]
        odds = [math.exp(x - max(logs)) for x in logs]
        r = got[doc_id, text]
        if any(c.isalpha() for c in text or ""):
            assert r.lang_pred == "xy"[odds.index(max(odds))] and math.isclose(r.score, max(odds) / sum(odds), rel_tol=1e-4)
        else:
            assert (r.lang_pred, r.score) == ("und", 1.0)


def test_equally_likely_languages_go_by_name(spark):
    p = model().probability
    m = langid.Model(["a", "b"], model().pieces, np.stack([p[:, 0], p[:, 0]], axis=1))
    assert {r.lang_pred for r in langid.predict(documents(spark).filter("doc_id = 1"), m, ["doc_id"]).collect()} == {"a"}


def test_extra_columns_never_clash(spark):
    df = documents(spark).selectExpr("*", "1 as _d", "2 as _p", "3 as _keep_text", "4 as lang_pred", "5 as score", "6 as `a.b`")
    out = langid.known_languages(df)
    assert out.columns == df.columns and {(r._d, r.lang_pred, r["a.b"]) for r in out.collect()} == {(1, 4, 6)}
