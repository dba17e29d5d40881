"""Near-duplicate documents: fast similarity sketching, banding, exact links.

Sketch: in round i every shingle lands in one hashed bin (from round t on, in
bin i - t, so that each of the t bins is filled at last); a bin keeps the least
(round, hash).  Bands of r bins are candidate keys.  With the production
settings a pair at the threshold shares no band with probability below 1e-8.

Texts with equal shingle sets are one node from the start.  Nodes that share a
band are candidates; a node of which too few shingles occur in any other
candidate can have no link and is dropped (an exact bound).  Links are then
confirmed on full sets: first each bucket's members against one member, which
joins large groups in linear work.  Of the nodes whose buckets still hold several
components, every pair is tried that shares one of the rarest shingles which a pair
at the threshold must share (prefix filter): a band that many unlike documents have
in common costs nothing there.  No cap is set anywhere.

Defined results for odd input: null, empty or word-less texts have an empty
set and no link; fewer words than a shingle are one shingle; repeated rows and
equal texts are linked; a doc_id that stands for several texts keeps one row
for each; where all ids of a component are null, so is its component_id, and
kept holds for its rows; very long texts are read whole; an empty table gives none;
extra columns are ignored.  Sets are of 64-bit hashes of words in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import discard, few_tasks, materialize, small_batches
from .texthash import mix, shingle_sets

_U = np.uint64
EMPTY = _U(0xFFFFFFFFFFFFFFFF)


#: Sets of so few shingles get all their rounds at once.
SMALL = 32


def _place(out: np.ndarray, bins: int, values: np.ndarray, doc: np.ndarray, rounds: np.ndarray) -> None:
    """Let values fall into their documents' bins in the given rounds."""
    h = mix(values[:, None] + (_U(2) * rounds.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15))
    bin_ = np.where(rounds < bins, ((h & _U(0xFFFFFFFF)) * _U(bins) >> _U(32)).astype(np.int64), rounds - bins)
    np.minimum.at(out, (doc[:, None] * bins + bin_).reshape(-1), (rounds.astype(np.uint64) << _U(54) | h >> _U(10)).reshape(-1))


def sketch(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """The sketches of non-empty sets, one row each."""
    out = np.full(len(sets) * bins, EMPTY, np.uint64)
    sizes = np.array([len(s) for s in sets])
    values, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    few = (sizes <= SMALL)[doc]
    every = np.arange(2 * bins)
    at = np.flatnonzero(few)
    for part in np.array_split(at, len(at) // 2048 + 1):
        _place(out, bins, values[part], doc[part], every)
    values, doc = values[~few], doc[~few]
    for i in every:
        if not len(doc):
            break
        _place(out, bins, values, doc, every[i : i + 1])
        keep = (out.reshape(-1, bins) == EMPTY).any(axis=1)[doc]
        values, doc = values[keep], doc[keep]
    return out.reshape(-1, bins)


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = sketches.reshape(len(sketches), bands, rows)
    h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), x.shape[:2]).copy()
    for i in range(rows):
        h = mix(h * _U(0xD6E8FEB86659FD93) + x[:, :, i])
    return h


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketched(documents: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """uid, doc_id, n_shingles, digest, bands: one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), k):
                full = [s for s in sets if len(s)]
                keys = band_keys(sketch(full, bands * rows), bands, rows) if full else np.zeros((0, bands), np.uint64)
                ends = np.cumsum([0] + [bands * bool(len(s)) for s in sets]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(at, at + len(sets))),
                        batch.column(0).slice(first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    names=["uid", "doc_id", "n_shingles", "digest", "bands"],
                )
                at += len(sets)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"uid long, doc_id {kind}, n_shingles long, digest binary, bands array<long>")


#: Numbers of 64 bits that hold the parities of a set's hashed shingles.
PARITY = 8


def parity(s: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of shingles falls on it: two sets differ
    in at least as many elements as their parities do in bits."""
    return np.packbits(np.bincount((s >> _U(55)).astype(np.int64), minlength=64 * PARITY) & 1, bitorder="little").view(np.int64)


def _full_sets(documents: DataFrame, k: int) -> DataFrame:
    """digest, shingles, parity of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), k):
                ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64))), pa.array([parity(s) for s in sets], pa.list_(pa.int64()))], names=["digest", "shingles", "parity"])

    return documents.select("text").mapInArrow(run, "digest binary, shingles array<long>, parity array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) that reach the threshold on full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    return both.filter(f"n * {threshold.denominator}L >= (na + nb - n) * {threshold.numerator}L").select("a", "b")


def _pairs(x: DataFrame) -> DataFrame:
    return x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _possible(threshold: Fraction, a: str, b: str) -> F.Column:
    """Whether sets can reach the threshold, by their columns size_, common_ and
    parity_: an overlap is at most the shingles that are not a set's alone, and
    a difference at least that of the parities."""
    p, q = threshold.numerator, threshold.denominator
    apart = " + ".join(f"bit_count(parity_{a}[{i}] ^ parity_{b}[{i}])" for i in range(PARITY))
    both = f"(size_{a} + size_{b})"
    return F.expr(f"least(common_{a}, common_{b}) * {p + q}L >= {both} * {p}L and ({apart}) * {p + q}L <= {both} * {q - p}L")


def rare_shingles(nodes: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """nodes with a row per shingle (key) of which two sets at the threshold share one at least.

    With t the threshold, such sets share t of the larger one's shingles, so some of the
    size - ceil(t * size) + 1 that come first in any common order; here the rarest among nodes do.
    Shingles of one node alone come first of all and are left out; a key whose nodes are
    all of one component goes.
    """
    p, q = threshold.numerator, threshold.denominator
    each = sets.join(nodes.select("node", "root"), "node").select("node", "root", F.explode("shingles").alias("s"))
    counts = each.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("n > 1")
    counts = materialize(counts.select("s", "n", (F.col("lo") < F.col("hi")).alias("mixed")), "neardup-counts")
    # One document's shingles at a time, as in sets.
    ranked = each.join(counts, "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "s", "mixed"))).alias("all"))
    ranked = ranked.join(nodes, "node").withColumn("most", F.expr(f"size(all) - (size * {p}L + {q - 1}) div {q} + 1").cast("int"))
    ranked = ranked.filter("most > 0").withColumn("of", F.explode(F.expr("slice(all, 1, most)"))).filter("of.mixed")
    return materialize(ranked.select(F.col("of.s").alias("key"), *nodes.columns), "neardup-rare")


def links(buckets: DataFrame, sets: DataFrame, threshold: Fraction, pivots: int = 2) -> tuple[DataFrame | None, DataFrame | None]:
    """(links found, roots): links that connect what any link within a bucket connects.

    buckets: key, node, size, common (shingles that another candidate has too), parity.
    The first pivot of a bucket is the node with the fewest shingles of its own,
    the middle of a group of edited copies.  The work is linear in the bucket
    rows, but for pairs of different components that share a rare shingle and pass
    the bounds on sizes and overlap; those are all tried.
    """
    found, roots, tried, open_ = None, None, None, buckets.withColumn("root", F.col("node"))
    rows, passed = buckets.count(), []  # rows: of buckets, thus at most of what is made of them a bucket or node
    for turn in range(pivots + 1):
        named = lambda s: open_.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "root", "size", "common", "parity")))  # noqa: B023, E731
        if turn < pivots:
            order = (F.col("size_b") - F.col("common_b") if turn == 0 else F.xxhash64(F.lit(turn), "node_b")).cast("long")
            pivot = named("b").withColumn("order", order)
            pivot = pivot.groupBy("key").agg(F.min(F.struct("order", *(c for c in pivot.columns if c not in ("key", "order")))).alias("v")).select("key", "v.*")
            passed.append(pivot := materialize(few_tasks(pivot, rows), "neardup-pivots"))
            new = named("a").join(pivot, "key").filter(F.expr("root_a <> root_b") & _possible(threshold, "a", "b"))
        else:
            passed.append(rare := rare_shingles(open_.drop("key").distinct(), sets, threshold))
            x, y = (rare.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "root", "size", "common", "parity"))) for s in "ab")
            new = x.join(y, (x.key == y.key) & F.expr("node_a < node_b and root_a <> root_b") & _possible(threshold, "a", "b"))
        new = new.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        new = _pairs(new)
        if tried is not None:
            new = new.join(tried, ["a", "b"], "left_anti")
        new = materialize(few_tasks(new, rows) if turn < pivots else new, "neardup-pairs")
        passed.append(new)
        tried = new if tried is None else tried.union(new)
        good = materialize(_confirm(new, sets, threshold), "neardup-links")
        found = good if found is None else found.union(good)
        joined = not good.isEmpty()
        if joined or roots is None:
            was, roots = roots, components(good if roots is None else good.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
            if was is not None:
                discard(was)
        if turn < pivots and (joined or not turn):
            now = open_.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            mixed = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
            passed.append(open_ := materialize(few_tasks(now.join(mixed, "key", "left_semi"), rows), "neardup-open"))
            if open_.isEmpty():
                break
    discard(*passed)
    return found, roots


def near_duplicates(documents: DataFrame, k: int, threshold: Fraction, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of documents, and uid."""
    spark = documents.sparkSession
    small_batches(spark)
    all_ = materialize(_sketched(documents, k, bands, rows), "neardup-sketches")
    full = all_.filter("n_shingles > 0")
    n = all_.count()
    nodes = materialize(few_tasks(full.groupBy("digest").agg(F.min("uid").alias("node")), n), "neardup-nodes")  # a plain input: its join's skew can be split
    members = all_.select("uid", "doc_id", "n_shingles", "digest").join(nodes, "digest", "left").select("uid", "doc_id", "n_shingles", F.coalesce("node", "uid").alias("node"))
    members = materialize(few_tasks(members, n), "neardup-members")
    banded = full.join(members.filter("uid = node").select("uid"), "uid", "left_semi").select(F.col("uid").alias("node"), F.col("n_shingles").alias("size"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("key")
    buckets = materialize(banded.join(shared, "key", "left_semi"), "neardup-buckets")
    wanted = buckets.select("node").distinct().join(all_.select(F.col("uid").alias("node"), "doc_id", "digest"), "node")
    wanted = materialize(few_tasks(wanted, n), "neardup-wanted")
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    texts = documents.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = materialize(_full_sets(texts, k).join(wanted.select("node", "digest"), "digest").dropDuplicates(["node"]).select("node", "shingles", "parity"), "neardup-sets")
    discard(all_, nodes, wanted)
    # An upper bound of any overlap: shingles that another candidate has too.
    each = sets.select("node", F.explode("shingles").alias("s"))
    common = each.groupBy("s").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("s")
    enough = each.join(common, "s", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    enough = enough.withColumnRenamed("n", "common").join(sets.select("node", "parity"), "node")
    banded, buckets = buckets, materialize(buckets.join(enough, "node").filter(f"common * {threshold.denominator}L >= size * {threshold.numerator}L"), "neardup-buckets")
    discard(banded)
    _, roots = links(buckets, sets, threshold)
    discard(sets, buckets)
    # Names go to nodes first, so that the last join has plain inputs, whose skew is split.
    heads = members.groupBy("node").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n")).join(roots, "node", "left").filter("n > 1 or root is not null")
    heads = materialize(few_tasks(heads.select("node", "head", F.coalesce("root", "node").alias("root")), n), "neardup-heads")
    names = heads.groupBy("root").agg(F.min("head").alias("component_id"))
    named = materialize(heads.join(names, "root").select("node", F.struct("component_id").alias("name")), "neardup-names")
    discard(heads, roots)
    out = members.join(named, "node", "left")
    component = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("name.component_id"))
    out = out.select("uid", "doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(documents, 3, Fraction(85, 100), 32, 5).drop("uid")


def keep_one(documents: DataFrame, k: int = 5, threshold: Fraction = Fraction(8, 10), bands: int = 40, rows: int = 4) -> DataFrame:
    """The rows of documents that a component keeps: those with its least doc_id."""
    keep = near_duplicates(documents, k, threshold, bands, rows).filter("kept").select(F.struct("doc_id").alias("id")).distinct()
    rows_ = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("d"))
    return rows_.join(keep, F.struct("d.doc_id").eqNullSafe(F.col("id")), "left_semi").select("d.*")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                             WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i.c >= 85 * (p.c + q.c - i.c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, min(r.y) AS component_id, d.doc_id = min(r.y) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.x = d.doc_id
GROUP BY d.doc_id, n.c
"""
