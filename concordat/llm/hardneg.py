"""Hard negatives by norm-bucketed exact search.

Candidates are sorted by norm, longest first, and cut into buckets.  A task holds a
group of anchors and streams its share of the buckets in that order.  Each anchor has
windows of scores (for positives one without limits; for negatives one for each
positive); by Cauchy-Schwarz no row of a bucket scores above the anchor's norm times
the bucket's longest norm, so a window is closed once that falls below its lower
limit or below its running kth score, and a share is left when no window is open.
Groups of anchors meet shares of buckets in a grid, so each side is sent once per row
or column of the grid and a task holds one group and one bucket.  The kth scores run
within a share; the shares' best are merged at last, so results are exact.

Defined results for odd input: rows with a null id or label, a null vector, or a null
or non-finite component take no part; vectors of different lengths are padded with
zeros, an empty one scores 0; rows that repeat an id are rows of their own, and an
anchor is never its own positive but may have its copy as one; equal scores go by
the smaller id; an anchor without positives or a positive without negatives gives no
rows, as does an empty table; extra columns are ignored.  Scores are exact integers;
one beyond 64 bits fails.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, partitions

#: Rows of a bucket, and of a block of anchors.
BUCKET = 128
#: Anchors of a group: what a task holds, with their windows.
GROUP = 4096
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max
#: Below this, sums of products of whole numbers are exact in doubles.
EXACT = float(1 << 53)

_PACKED = "norm double, dim int, wide boolean, rows array<long>, ids array<long>, labels array<long>, vectors binary, slots array<int>, positive_ids array<long>, positive_scores array<long>"


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of at most BUCKET rows, in the order given within partitions.

    rows: row, id, label, norm, vector, and positives (array of struct<id, score>, may be null).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for whole in batches:
            for first in range(0, whole.num_rows, BUCKET):
                b = whole.slice(first, BUCKET)
                vectors = b.column("vector")
                sizes = np.diff(vectors.offsets.to_numpy())
                dim = int(sizes.max())
                m = np.zeros((b.num_rows, dim))
                m[np.arange(dim) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
                wide = bool(dim and np.abs(m).max() > 32767)
                positives = b.column("positives").to_pylist()
                flat = [p for ps in positives for p in ps or ()]
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "block": at, "norm": float(b.column("norm").to_numpy().max()), "dim": dim, "wide": wide, "rows": b.column("row").to_pylist(), "ids": b.column("id").to_pylist(),
                            "labels": b.column("label").to_pylist(), "vectors": m.astype("<f8" if wide else "<i2").tobytes(), "slots": [len(ps or ()) for ps in positives],
                            "positive_ids": [p["id"] for p in flat], "positive_scores": [p["score"] for p in flat],
                        }
                    ],
                    schema=_arrow("block int, " + _PACKED),
                )
                at += 1

    return rows.select("row", "id", "label", "norm", "vector", "positives").mapInArrow(run, "block int, " + _PACKED)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


@dataclass
class Block:
    norm: float
    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, r: dict) -> Block:
        longs = (np.array(r[k], np.int64) for k in ("rows", "ids", "labels"))
        return cls(r["norm"], *longs, np.frombuffer(r["vectors"], "<f8" if r["wide"] else "<i2").astype(float).reshape(len(r["ids"]), r["dim"]))


def _products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of whole-number rows."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return whole(a).dot(whole(b).T).astype(np.int64) if dim else np.zeros((len(a), len(b)), np.int64)


class Windows:
    """The k best rows of each window of each anchor of a group."""

    def __init__(self, k: int, same_label: bool):
        self.k, self.same = k, same_label
        self.blocks: list[Block] = []
        self.of: list[np.ndarray] = []  # a window's anchor
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.names: list[tuple] = []
        self.scored = 0  # buckets that were not pruned

    def add(self, block: Block, slots: np.ndarray, names: list, low: np.ndarray, high: np.ndarray) -> None:
        self.of.append(np.repeat(np.arange(len(slots)), slots) + sum(len(b.ids) for b in self.blocks))
        self.blocks.append(block)
        self.low.append(low)
        self.high.append(high)
        self.names += names

    def begin(self) -> None:
        dim = max(b.vectors.shape[1] for b in self.blocks)
        self.vectors = np.concatenate([np.pad(b.vectors, ((0, 0), (0, dim - b.vectors.shape[1]))) for b in self.blocks])
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        self.rows, self.ids, self.labels = (np.concatenate([getattr(b, x) for b in self.blocks]) for x in ("rows", "ids", "labels"))
        self.of, self.low, self.high = (np.concatenate(x) for x in (self.of, self.low, self.high))
        n = len(self.of)
        self.scores, self.found = np.full((n, self.k), NONE), np.full((n, self.k), LAST)
        self.open = self.low <= self.high

    def scan(self, bucket: Block) -> bool:
        """Take in a bucket; False when no bucket of this norm or below can matter."""
        floor = np.maximum(self.low, self.scores[:, -1])
        self.open &= self.norms[self.of] * bucket.norm * (1 + 1e-9) >= floor
        at = np.flatnonzero(self.open)
        if not len(at):
            return False
        self.scored += 1
        anchors, of = np.unique(self.of[at], return_inverse=True)
        products = _products(self.vectors[anchors], bucket.vectors, float(self.norms[anchors].max() * bucket.norm))
        fits = (self.labels[anchors][:, None] == bucket.labels) == self.same
        fits &= self.rows[anchors][:, None] != bucket.rows
        step = max(1, (1 << 21) // len(bucket.ids))
        for first in range(0, len(at), step):  # bounded memory: 2 million cells at once
            some, own = at[first : first + step], of[first : first + step]
            s = products[own]
            w, c = np.nonzero(fits[own] & (s >= floor[some][:, None]) & (s <= self.high[some][:, None]))
            if len(w):
                self._merge(some[w], s[w, c], bucket.ids[c])
        return True

    def _merge(self, window: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        touched = np.unique(window)
        window = np.concatenate([window, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.scores[touched].reshape(-1)])
        id_ = np.concatenate([id_, self.found[touched].reshape(-1)])
        order = np.lexsort((id_, ~score, window))  # ~ reverses the order and has no overflow
        window, score, id_ = window[order], score[order], id_[order]
        rank = np.arange(len(window)) - np.searchsorted(window, window)
        keep = rank < self.k
        self.scores[window[keep], rank[keep]] = score[keep]
        self.found[window[keep], rank[keep]] = id_[keep]

    def result(self) -> pa.RecordBatch:
        w, j = np.nonzero(self.scores > NONE)
        own = self.of[w]
        names = [self.names[i] for i in w]
        cols = [self.rows[own], self.ids[own], np.array([n[0] for n in names], np.int32), np.array([n[1] for n in names], np.int64), np.array([n[2] for n in names], np.int64), self.found[w, j], self.scores[w, j]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_FOUND_NAMES)


_FOUND = "row long, anchor_id long, slot int, positive_id long, positive_score long, id long, score long"
_FOUND_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _positive_windows(r: dict) -> tuple:
    n = len(r["ids"])
    return np.ones(n, int), [(0, 0, 0)] * n, np.full(n, NONE), np.full(n, LAST)


def _negative_windows(low: int, high: int):
    def run(r: dict) -> tuple:
        scores = r["positive_scores"]
        slots = np.array(r["slots"], int)
        names = list(zip([i for n in slots for i in range(n)], r["positive_ids"], scores, strict=True))
        return slots, names, np.array([-(-low * s // 100) for s in scores], np.int64), np.array([high * s // 100 for s in scores], np.int64)

    return run


def searched(anchors: DataFrame, buckets: DataFrame, n_anchors: int, k: int, same_label: bool, windows) -> DataFrame:
    """The k best rows of each anchor's windows over all buckets: ``_FOUND`` with rank.

    The grid has a column for each group of anchors and as many rows (shares of the
    buckets) as give every task a cell.
    """
    tasks = partitions(anchors.sparkSession)
    groups = max(1, -(-n_anchors // GROUP))
    shares = max(1, -(-tasks // groups))
    cell = lambda group, share: (group * shares + share).cast("int").alias("cell")
    blocks = packed(anchors.repartition(groups)).withColumn("group", F.spark_partition_id())
    blocks = blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    dealt = buckets.withColumn("share", F.pmod(F.col("part") + F.col("block"), F.lit(shares))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    tidy = [f.split()[0] for f in _PACKED.split(", ")]
    both = blocks.select(cell(F.col("group"), F.col("share")), F.lit(0).alias("kind"), *tidy).unionByName(dealt.select(cell(F.col("group"), F.col("share")), F.lit(1).alias("kind"), *tidy))
    both = both.repartitionById(groups * shares, F.col("cell")).sortWithinPartitions("cell", "kind", F.desc("norm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun, more = -1, None, False, True
        for r in (r for b in batches for at in range(b.num_rows) for r in b.slice(at, 1).to_pylist()):
            if r["cell"] != now:
                if begun:
                    yield state.result()
                now, state, begun, more = r["cell"], Windows(k, same_label), False, True
            if not r["kind"]:
                state.add(Block.of(r), *windows(r))
            elif state.blocks and more:
                if not begun:
                    state.begin()
                    begun = True
                more = state.scan(Block.of(r))
        if begun:
            yield state.result()

    found = both.mapInArrow(run, _FOUND)
    best = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id")  # k rows of each share at most
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: id, label (whole numbers) and vector (array of whole-number doubles); anchor:
    a condition on them.  Of each anchor's best ``positives`` rows of its label, the
    best ``negatives`` rows of other labels that score from low to high percent of it.
    """
    spark = rows.sparkSession
    v = F.col("vector")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    part = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), v.cast("array<double>"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    part = part.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).filter(F.forall(v, finite))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    part = part.withColumns({"norm": norm, "row": F.monotonically_increasing_id(), "positives": F.lit(None).cast("array<struct<id:long,score:long>>")})
    kept = materialize(part, "hardneg-rows")
    tasks = partitions(spark)
    ordered = kept.repartitionByRange(tasks, F.desc("norm"), "id", "row").sortWithinPartitions(F.desc("norm"), "id", "row")
    buckets = materialize(packed(ordered).withColumn("part", F.spark_partition_id()), "hardneg-buckets")
    anchors = kept.filter("anchor").drop("positives")
    n = anchors.count()
    none = F.lit(None).cast("array<struct<id:long,score:long>>").alias("positives")
    best = searched(anchors.select("*", none), buckets, n, positives, True, _positive_windows)
    best = best.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("positives"))
    # a list of at most ``positives`` for each anchor
    asked = materialize(anchors.join(best, "row"), "hardneg-anchors")
    found = searched(asked, buckets, n, negatives, False, _negative_windows(low, high))
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_norm_bucketed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = e.filter(finite).select(F.col("vec_id").alias("id"), label.alias("label"), vector.alias("vector"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


ORACLE_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id AS other_id, c.r AS other_r, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.r <> c.r WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.r = s.r AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.r, p.other_r ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 5
"""
