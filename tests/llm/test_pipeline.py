import random
import re

import public_tokenizers
import pytest
from fixtures import documents
from tokenizers import Tokenizer

import corpus_pipeline as cp


def corpus():
    rng = random.Random(11)
    en, de = (["the", "of", "and", "tion", "ing", "her", "ent"], ["der", "und", "ung", "keit", "sch", "ein", "lich"])
    line = lambda s, n: " ".join("".join(rng.choices(s, k=rng.randrange(1, 4))) for _ in range(n))
    bench = [(i, line(en, 20)) for i in range(3)]
    passage = line(en, 60)
    docs = [(i, "\n".join(line(en if i % 2 else de, 25) for _ in range(3)), "en" if i % 2 else "de") for i in range(60)]
    clean = {d for d, _, _ in docs}
    docs += [(100, "12 34 !!", "en"), (101, None, "de"), (102, "", None)]
    docs += [(110 + i, f"{passage}\n{line(en, 30)}", "en") for i in range(3)]
    docs += [(120, docs[7][1], "en"), (121, " ".join(docs[9][1].replace("\n", " ").split()[:-1]), "en")]
    docs += [(130, line(en, 15) + " " + bench[1][1] + " " + line(en, 5), "en")]
    return docs, bench, clean | {110, 111, 112}, passage


def test_stages_catch_what_is_planted_and_keep_the_rest(spark, tmp_path):
    rows, bench, clean, passage = corpus()
    docs = spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns, steps = docs.columns, {}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        steps[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not {100, 101, 102} & set(steps["language ID"]) and clean < set(steps["language ID"])
    lined = steps["line dedup"]
    assert sum(passage in t for t in lined.values()) == 1
    assert 120 not in lined and clean <= set(lined)
    assert 121 not in steps["MinHash near-dedup"] and clean <= set(steps["MinHash near-dedup"])
    assert set(steps["benchmark decontamination"]) == clean
    packed = cp.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in steps["benchmark decontamination"].items()}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == ids
    whole = cp.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, packed))


@pytest.mark.parametrize("k", range(len(cp.STAGES)))
def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path, k):
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (documents(spark), documents(spark).filter("false")):
        out = cp.STAGES[k][1](spark, docs, str(tmp_path))
        out.collect()
        if k < len(cp.STAGES) - 1:
            assert out.columns == docs.columns


def test_stage_names():
    assert [re.sub(r"\W", "", n) for n, _ in cp.STAGES] == ["languageID", "linededup", "MinHashneardedup", "benchmarkdecontamination", "packing"]
