"""A training corpus from raw documents, in five stages.

language ID drops documents without letters (with any, the best of the learned
languages is nearly always confident, so other languages pass); line dedup removes
lines of 25 characters and more that near-repeat earlier ones; MinHash keeps one document of each
near-duplicate component; decontamination drops documents that share ten words
in a row with the benchmark; packing cuts the rest into token windows.
Each stage is written as Parquet and read again before the next.  The result has a
row per piece with its token ids (little-endian unsigned 32-bit).

Defined results for odd input: documents with null, empty or letterless text go in
the first stage; a null doc_id is a document of its own kind, first in packing's
order; rows that repeat a doc_id are judged together where a stage names documents
(near copies, benchmark hits), else one by one; of ties the least doc_id stays;
extra columns, whatever their names, pass through to packing; empty tables give no
rows; an empty benchmark drops nothing; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concordat.llm.decontam import drop_contaminated
from concordat.llm.langid import known_languages
from concordat.llm.linededup import drop_repeated_lines
from concordat.llm.neardup import keep_one
from concordat.llm.packing import pack
from concordat.llm.shared import scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return known_languages(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]

#: Language ID, the edit join and the tokenizer are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
