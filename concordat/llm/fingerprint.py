"""One-permutation MinHash fingerprints, from built-in functions only.

Each shingle is hashed once.  The hash's top bits are its bin, the least hash
of a bin is the bin's value.  An empty bin borrows from another: it tries
``PROBES`` hashed bins and then takes the non-empty bin of least hashed rank,
so that it picks uniformly among the non-empty bins, each empty bin on its own
(optimal densification).  Of each bin 8 low-order bits are stored, after the
value is hashed with the bin's number; chance agreement of such codes is taken
out of the likeness.

Defined results for odd input: null, empty or word-less texts have the empty
fingerprint, which is alike (1) to itself and unlike (0) to all others; fewer
words than a shingle are one shingle; equal texts have equal fingerprints; texts of
any length are read whole; of rows with one doc_id the next is the one whose text's
hash follows, and rows that repeat both follow each other in any order, with
the same results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import partitions

BINS_LOG2 = 9
BINS = 1 << BINS_LOG2
CODE_BITS = 8
PER_WORD = 4  # codes in a stored number, so that sums stay in range
PROBES = 24
_SHIFT = 64 - BINS_LOG2
_CHANCE = 2.0**-CODE_BITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, k: int = 5) -> Column:
    """Sorted hashes of the k-word shingles, empty for no words."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")

    def shingles(h: Column) -> Column:
        run = lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k)))
        return F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.size(h) - k), run)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return F.sort_array(let(F.transform(words, lambda w: F.xxhash64(w)), shingles))


def _bin(h: Column) -> Column:
    return F.shiftright(h, _SHIFT) + F.lit(BINS // 2)


def _bins(firsts: Column) -> Column:
    """The bins' values in order, null where empty."""
    none = F.lit(None).cast("bigint")

    def with_gap(h: Column, i: Column) -> Column:
        before = F.when(i > 0, _bin(F.get(firsts, i - 1))).otherwise(F.lit(-1).cast("bigint"))
        return F.concat(F.array_repeat(none, (_bin(h) - before - 1).cast("int")), F.array(h))

    tail = F.array_repeat(none, (F.lit(BINS - 1) - _bin(F.get(firsts, F.size(firsts) - 1))).cast("int"))
    return F.flatten(F.concat(F.transform(firsts, with_gap), F.array(tail)))


def _filled(bins: Column, firsts: Column) -> Column:
    def donor(b: Column) -> Column:
        probes = [F.get(bins, F.xxhash64(b, F.lit(t)).bitwiseAND(BINS - 1).cast("int")) for t in range(PROBES)]
        ranked = F.transform(firsts, lambda h: F.struct(F.xxhash64(b, F.lit(-1), _bin(h)).alias("r"), h.alias("h")))
        return F.coalesce(*probes, F.array_min(ranked)["h"])

    return F.transform(bins, lambda h, b: F.xxhash64(F.coalesce(h, donor(b)), b).bitwiseAND((1 << CODE_BITS) - 1))


def _packed(codes: Column) -> Column:
    def word(j: Column) -> Column:
        out = F.get(codes, j * PER_WORD)
        for i in range(1, PER_WORD):
            out = F.shiftleft(out, CODE_BITS).bitwiseOR(F.get(codes, j * PER_WORD + i))
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_WORD - 1)), word)


def fingerprint(text: Column, k: int = 5) -> Column:
    """array<bigint> of packed codes; empty for a text without words."""

    def of(hashes: Column) -> Column:
        first_of_bin = F.filter(hashes, lambda h, i: (i == 0) | (F.shiftright(h, _SHIFT) != F.shiftright(F.get(hashes, i - 1), _SHIFT)))
        full = let(first_of_bin, lambda firsts: let(_bins(firsts), lambda bins: let(_filled(bins, firsts), _packed)))
        return F.when(F.size(hashes) > 0, full).otherwise(F.array().cast("array<bigint>"))

    return let(shingle_hashes(text, k), of)


def to_text(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), PER_WORD * CODE_BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity, 0 to 1, less chance agreement of codes."""
    ones = int("7F" * PER_WORD, 16)
    tops = int("80" * PER_WORD, 16)

    def equal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)  # a code's top bit stays clear below only if its byte is zero
        seen = (d.bitwiseAND(ones) + F.lit(ones)).bitwiseOR(d)
        return F.bit_count(F.bitwise_not(seen).bitwiseAND(tops))

    same = F.aggregate(F.zip_with(a, b, equal), F.lit(0), lambda s, n: s + n)
    estimate = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - _CHANCE) / (1 - _CHANCE))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(estimate)


def _bucket(key: Column, bounds: list) -> Column:
    """How many bounds are below key, by bisection; null keys are below all."""
    if not bounds:
        return F.when(key.isNull(), -1).otherwise(0)
    held = F.array(*map(F.lit, bounds))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(held, mid) < key
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(mid).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(0), F.lit(len(bounds).bit_length())), start, step, lambda s: s["lo"])
    return F.when(key.isNull(), -1).otherwise(found)


def with_next(rows: DataFrame, key: str, tie: str, carry: list[str]) -> DataFrame:
    """rows with next_<c> of the row that follows in descending order of key, tie;
    the last row is followed by the first.

    One shuffle: buckets of the key's quantiles are sorted apart, and each gets
    a copy of the row that opens the next bucket.  The driver holds one bound
    and one key per bucket; the buckets are as many as shuffle partitions.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    bounds = rows.agg(F.percentile_approx(key, F.array(*(F.lit((i + 1) / n) for i in range(n - 1))), F.lit(100 * n)) if n > 1 else F.lit(None)).first()[0]
    rows = rows.withColumn("_g", _bucket(F.col(key), sorted(set(bounds or []))))
    tops = rows.groupBy("_g").agg(F.max(F.struct(key, tie)).alias("t")).orderBy(F.desc("_g")).collect()  # a row per bucket
    halo = [(int(g["_g"]), f["t"][0], f["t"][1]) for g, f in zip(tops, tops[1:] + tops[:1], strict=True)]
    kind = f"_to int, _key {rows.schema[key].dataType.simpleString()}, _tie {rows.schema[tie].dataType.simpleString()}"
    table = spark.createDataFrame(halo, kind).groupBy("_key", "_tie").agg(F.collect_list("_to").alias("_to"))
    rows = rows.join(F.broadcast(table), F.col(key).eqNullSafe(F.col("_key")) & F.col(tie).eqNullSafe(F.col("_tie")), "left")
    places = F.concat(F.array(F.struct(F.col("_g").alias("g"), F.lit(False).alias("halo"))), F.transform(F.coalesce("_to", F.array().cast("array<int>")), lambda g: F.struct(g.alias("g"), F.lit(True).alias("halo"))))
    rows = rows.withColumn("_p", F.explode(places)).drop("_key", "_tie", "_to", "_g")
    w = Window.partitionBy("_p.g").orderBy("_p.halo", F.desc_nulls_last(key), F.desc_nulls_last(tie))
    rows = rows.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carry))
    return rows.filter(~F.col("_p.halo")).drop("_p")


def edited_fingerprints(documents: DataFrame, k: int = 5) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie"))
    placed = with_next(rows.select("doc_id", "tie", "text", fingerprint(F.col("text"), k).alias("f")), "doc_id", "tie", ["text", "f"])
    n = F.char_length("text").cast("long")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (n - cut).cast("int")), F.substr("next_text", F.lit(1), cut))
    out = placed.select("doc_id", n.alias("n_chars"), edited.alias("edited"), "f", "next_f")
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "f", "next_f", fingerprint(F.col("edited"), k).alias("e"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", to_text(F.col("f")).alias("fingerprint"), to_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("next_f")).alias("near_next"),
    )


def op3_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
