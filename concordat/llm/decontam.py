"""Benchmark decontamination by winnowing.

Both sides keep, of each window of w consecutive k-gram hashes, the least (the
rightmost of equals); any shared run of w + k - 1 words therefore has a
fingerprint that both sides keep at the same place of the run.  Documents'
fingerprints that a fixed-size bitmap of the benchmark's rules out are dropped
at once; the others join the benchmark's, and a hit is extended: it counts for
each window of 10 words around it that is the same on both sides.

The bitmap has a fixed size whatever the benchmark's; the join is an ordinary
equi-join, whose side Spark broadcasts only below its own threshold.

Defined results for odd input: a null text has no words; an item without words
has no window; an item of fewer words than the window is one window of its
own; repeated item ids count as one item; repeated document rows each give a
row; very long texts are read whole; an empty table gives none, an empty benchmark
no hit; extra columns are ignored.  Windows are compared by the hashes of their
fingerprint and of all their words (64 bits each, words in order); an item of one
common word is as many hits as there are documents with it, which its contract asks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, small_batches
from .texthash import ALNUM, mix, window_hash, words

_U = np.uint64
WINDOW, K = 10, 5
#: Bits of the bitmap of benchmark fingerprints (2 MiB), at any benchmark size.
BITMAP_BITS = 1 << 24

HIT = pa.struct([("fp", pa.int64()), ("at", pa.int64()), ("starts", pa.list_(pa.int64())), ("windows", pa.list_(pa.int64()))])


def winnow(hashes: np.ndarray, group: np.ndarray, span: int) -> np.ndarray:
    """Places kept: the least hash of each ``span`` consecutive places of a group,
    the rightmost of equals."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    whole = np.flatnonzero(group[:n] == group[span - 1 :])
    best, place = hashes[whole].copy(), whole.copy()
    for i in range(1, span):
        h = hashes[whole + i]
        take = h <= best
        best[take], place[take] = h[take], whole[take] + i
    return np.unique(place)


def _fingerprints(w, window: int, k: int):
    """(places of fingerprints among words, fingerprints) of a run of texts."""
    at, h = w.shingles(k)
    kept = winnow(h, w.doc[at], window - k + 1)
    return at[kept], h[kept]


def _around(w, bounds: np.ndarray, place: int, window: int, k: int):
    """(start, hash) of the windows of the text that hold the k-gram at a place."""
    doc = w.doc[place]
    lo, hi = max(bounds[doc], place + k - window), min(place, bounds[doc + 1] - window)
    starts = np.arange(lo, hi + 1)
    return starts, window_hash(w.hash, starts, window)


def item_windows(benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """item_id, length, fp, shift, hash: a row per window of an item and
    fingerprint in it; a short item has one row, its fingerprint being its hash."""
    small_batches(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for w in words(batch.column(1), ALNUM):
                bounds, rows = w.bounds(), []
                for place, fp in zip(*_fingerprints(w, window, k), strict=True):
                    starts, hashes = _around(w, bounds, place, window, k)
                    rows += [(w.first + w.doc[place], window, fp, place - s, h) for s, h in zip(starts, hashes, strict=True)]
                sizes = np.diff(bounds)
                for i in np.flatnonzero((sizes > 0) & (sizes < window)):
                    h = window_hash(w.hash, bounds[i : i + 1], int(sizes[i]))[0]
                    rows.append((w.first + i, int(sizes[i]), h, 0, h))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                unsigned = lambda c: pa.array(np.array(c, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), unsigned(cols[2]), pa.array(cols[3], pa.int64()), unsigned(cols[4])], names=["item_id", "length", "fp", "shift", "hash"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return benchmark.select("item_id", "text").mapInArrow(run, f"item_id {kind}, length int, fp long, shift long, hash long").distinct()


def _bit(h: np.ndarray) -> np.ndarray:
    return (mix(h) & _U(BITMAP_BITS - 1)).astype(np.int64)


def bitmap(windows: DataFrame) -> np.ndarray:
    """Which of BITMAP_BITS hashed values occur among fp; built by aggregation,
    so at most BITMAP_BITS / 8 bytes reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(BITMAP_BITS, bool)
        for b in batches:
            own[_bit(b.column(0).to_numpy().view(np.uint64))] = True
        packed = np.packbits(own, bitorder="little").view("<i8")
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], names=["at", "bits"])

    cells = windows.select("fp").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    out[cells.column("at").to_numpy()] = cells.column("bits").to_numpy()
    return out.view(np.uint8)


def scan(documents: DataFrame, bits: np.ndarray, short: list[int], window: int = WINDOW, k: int = K) -> DataFrame:
    """uid, doc_id, n_words, hits: the fingerprints of each document that may be the
    benchmark's, with the windows around them.  short: lengths of short items."""
    spark = documents.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(bits)  # BITMAP_BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, known = TaskContext.get().partitionId() << 40, held.value

        def maybe(h):
            b = _bit(h)
            return (known[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)

        for batch in batches:
            for w in words(batch.column(1), ALNUM):
                bounds = w.bounds()
                hits: list[list[dict]] = [[] for _ in range(w.texts)]
                at, fp = _fingerprints(w, window, k)
                yes = maybe(fp)
                for place, f in zip(at[yes], fp[yes].view(np.int64), strict=True):
                    starts, hashes = _around(w, bounds, place, window, k)
                    doc = w.doc[place]
                    hits[doc].append({"fp": int(f), "at": int(place - bounds[doc]), "starts": (starts - bounds[doc]).tolist(), "windows": hashes.view(np.int64).tolist()})
                for n in short:
                    at, h = w.shingles(n)
                    yes = maybe(h)
                    for place, f in zip(at[yes], h[yes].view(np.int64).tolist(), strict=True):
                        doc = w.doc[place]
                        start = int(place - bounds[doc])
                        hits[doc].append({"fp": f, "at": start, "starts": [start], "windows": [f]})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + w.texts)), batch.column(0).slice(w.first, w.texts), pa.array(np.diff(bounds), pa.int64()), pa.array(hits, pa.list_(HIT))],
                    names=["uid", "doc_id", "n_words", "hits"],
                )
                uid += w.texts

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"uid long, doc_id {kind}, n_words long, hits array<struct<fp:long,at:long,starts:array<long>,windows:array<long>>>")


def spans(scanned: DataFrame, windows: DataFrame) -> DataFrame:
    """uid, item_id, start, length: each occurrence of an item's window in a document."""
    hits = scanned.filter("size(hits) > 0").select("uid", F.explode("hits").alias("h"))
    hits = hits.select("uid", F.col("h.fp").alias("fp"), F.col("h.at").alias("at"), F.explode(F.arrays_zip(F.col("h.starts").alias("start"), F.col("h.windows").alias("hash"))).alias("w"))
    hits = hits.select("uid", "fp", F.col("w.start").alias("start"), F.col("w.hash").alias("hash"), (F.col("at") - F.col("w.start")).alias("shift"))
    return hits.join(windows, ["fp", "shift", "hash"]).select("uid", "item_id", "start", "length").distinct()


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """uid, doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row."""
    windows = materialize(item_windows(benchmark, window, k), "decontam-items")
    short = sorted(r[0] for r in windows.filter(F.col("length") < window).select("length").distinct().collect())  # below the window's length
    scanned = materialize(scan(documents, bitmap(windows), short, window, k), "decontam-scan")
    found = materialize(spans(scanned, windows), "decontam-spans")
    before = Window.partitionBy("uid").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    pieces = found.select("uid", "start", "length").distinct().withColumn("end", F.col("start") + F.col("length"))
    pieces = pieces.withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0)))
    hit = pieces.groupBy("uid").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "seen"))).alias("n_hit"))
    items = found.select("uid", F.col("item_id").cast("string").alias("item")).distinct().groupBy("uid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = scanned.select("uid", "doc_id", "n_words").join(hit, "uid", "left").join(items, "uid", "left")
    return out.select(
        "uid", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(documents, benchmark).drop("uid")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents of whose id no row holds a benchmark window."""
    bad = contamination(documents, benchmark).filter("contaminated").select(F.struct("doc_id").alias("id")).distinct()
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("d"))
    return rows.join(bad, F.struct("d.doc_id").eqNullSafe(F.col("id")), "left_anti").select("d.*")


ORACLE_SQL = r"""
WITH low AS (
  SELECT 0 AS side, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 1, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT side, id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM low),
iw AS (SELECT DISTINCT id AS item_id, least(10, len(ws)) AS n, unnest(list_transform(range(1, greatest(1, len(ws) - 9) + 1), lambda i: array_to_string(ws[i : i + least(10, len(ws)) - 1], ' '))) AS g
       FROM w WHERE side = 1 AND len(ws) > 0),
ln AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT id AS doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i : i + n - 1], ' '))) AS g
       FROM w, ln WHERE side = 0 AND len(ws) >= n),
h AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY 1)
SELECT w.id AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c ON c.doc_id = w.id LEFT JOIN t ON t.doc_id = w.id WHERE side = 0
"""
