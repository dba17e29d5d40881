"""Katz backoff language model: counts, discounts, backoff weights and scores.

P(w | h) = d(c(hw)) c(hw) / c(h) where hw was seen, else alpha(h) P(w | h') with h' the
history without its first word, alpha(h) = (1 - sum of the seen w's P(w | h)) / (1 - sum
of their P(w | h')); a history that was never seen passes to h' with weight 1.  Every
history's probabilities, over the training types and one unknown type, add up to 1: the
unknown type has the mass that discounting takes from single words.  Up to five,
discounts are Turing's, d(r) = (r + 1) n(r+1) / (r n(r)), where that lies between 0 and 1;
else those of the straight line through log n(r) over log r, d(r) = (1 + 1/r)^(slope + 1),
whose slope is -1.1 at most, so that every history keeps some mass for unseen words.

Documents become blocks of tokens, written once.  For each order a block sends its
distinct n-grams, as sorted 64-bit hashes with their training counts, to partitions of the
hash range; a partition adds them up, keeps its part of the model's table and answers each
block in the order asked.  Weights go the same way: a block sends, for the histories that
scoring can meet, its share of c(h) and of the two sums above (over occurrences, each with
its type's part), and asks for those at which its held-out tokens back off.  Each token is
then scored from the answers, order by order.  A word as frequent as any is one row a
block, whatever its partition.

Defined results for odd input: null, empty or blank texts are the end token alone;
an unknown word is the unknown type; a null doc_id is training; repeated rows are documents
of their own; without training text every token has base and model probability of the
unknown type; a table without rows gives none; extra columns are ignored; texts of any
length are read whole (a block holds whole documents).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, materialize, partitions, scratch, settings
from .texthash import NOT_SPACE, window_hash, words

#: Tokens from which a block is full.
BLOCK = 1 << 19
#: Tokens whose shares a task adds up before it sends them.
HELD = 1 << 21
#: Counts up to which Turing's estimate is used, and counts of counts that are kept.
TURING, KEPT = 5, 10
#: Tokens that no word equals: hashes of no text, but for chance.
BEGIN, END = np.uint64(0xB5297A4D3F84D5A7), np.uint64(0x68E31DA4C2B2AE35)
#: Blocks are large rows.
FEW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "32"}


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first, without the last bytes that none fills; compressed
    by Zstandard, as shuffles code no entropy and small counts have little."""
    m = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    filled = int(np.flatnonzero(m.any(axis=1)).max(initial=0)) + 1
    return bytes([filled]) + zstandard.compress(np.ascontiguousarray(m[:filled]).tobytes(), 1)


def unplanes(b: bytes, kind: str) -> np.ndarray:
    m = np.frombuffer(zstandard.decompress(b[1:]), np.uint8)
    m = m.reshape(b[0], len(m) // b[0])
    out = np.zeros((m.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, : b[0]] = m.T
    return out.view(kind).reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, "<u8"), dtype=np.uint64)


class Block:
    """Tokens of consecutive documents."""

    def __init__(self, row: dict):
        self.id, self.lengths = row["block"], np.array(row["lengths"], np.int64)
        self.vocabulary, self.places = unpack_keys(row["vocabulary"]), unplanes(row["places"], "<u4")
        self.hashes = self.vocabulary[self.places]
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.held = np.array(row["held"], bool)[self.doc]
        self.first = np.cumsum(self.lengths) - self.lengths

    def _padded(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens with n - 1 begins before each document, and where each token's n-gram begins."""
        at = np.arange(len(self.doc)) + (n - 1) * (self.doc + 1)
        out = np.full(len(at) + (n - 1) * len(self.lengths), BEGIN)
        out[at] = self.hashes
        return out, at - (n - 1)

    def grams(self, n: int) -> np.ndarray:
        """The key of the n-gram that ends at each token."""
        return self.hashes if n == 1 else window_hash(*self._padded(n), n)

    def distinct(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams in order, and each token's place among them."""
        return (self.vocabulary, self.places) if n == 1 else np.unique(self.grams(n), return_inverse=True)

    def histories(self, n: int) -> np.ndarray:
        """The key of the n - 1 words before each token."""
        padded, at = self._padded(n)
        return padded[at] if n == 2 else window_hash(padded, at, n - 1)

    def before(self, x: np.ndarray, first) -> np.ndarray:
        """x of the token before, and ``first`` for a document's first token."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = first
        return out


_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_())}


def mapped(df: DataFrame, f: Callable[[Iterator[dict]], Iterator[dict]], ddl: str) -> DataFrame:
    """mapInArrow with rows as dictionaries, one at a time: rows are few and large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in ddl.split(", "))])
        for r in f(r for b in batches for at in range(b.num_rows) for r in b.slice(at, 1).to_pylist()):
            yield pa.RecordBatch.from_pylist([r], schema=schema)

    return df.mapInArrow(run, ddl)


def token_blocks(documents: DataFrame, held: Column) -> DataFrame:
    """block, doc_ids, held, lengths, vocabulary, places, train_docs."""
    kind = documents.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, full = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            vocabulary, places = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
            held = np.concatenate([p[1] for p in parts])
            ids = pa.concat_arrays([p[0] for p in parts])
            lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            cols = [pa.array([at]), lists(ids), lists(pa.array(held)), lists(pa.array(np.concatenate([p[2] for p in parts]), pa.int64())), pa.array([pack_keys(vocabulary)], pa.binary()), pa.array([planes(places.astype("<u4"))], pa.binary()), pa.array([int((~held).sum())])]
            return pa.RecordBatch.from_arrays(cols, names=["block", "doc_ids", "held", "lengths", "vocabulary", "places", "train_docs"])

        for b in batches:
            held = b.column("held").to_numpy(zero_copy_only=False).astype(bool)
            for w in words(b.column("text"), NOT_SPACE):
                tokens = np.full(len(w.hash) + w.texts, END)
                tokens[np.arange(len(w.hash)) + w.doc] = w.hash
                rows = slice(w.first, w.first + w.texts)
                parts.append((b.column("doc_id").slice(w.first, w.texts), held[rows], np.bincount(w.doc, minlength=w.texts) + 1, tokens))
                full += len(tokens)
                if full >= BLOCK:
                    yield block()
                    at, parts, full = at + 1, [], 0
        if parts:
            yield block()

    rows = documents.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held"))
    return rows.mapInArrow(run, f"block long, doc_ids array<{kind.simpleString()}>, held array<boolean>, lengths array<long>, vocabulary binary, places binary, train_docs long")


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition's keys begin, of sorted keys, and the end."""
    edges = np.array([-(-(i << 64) // parts) for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]]).astype(int)


_COUNTED = "kind int, n int, bucket int, block long, keys binary, counts binary, types long, total long, counts_of_counts array<long>"


def counted(tokens: DataFrame, n: int, parts: int) -> DataFrame:
    """kind 0: the answer to a block (training counts, doubled, odd if held-out text has the
    n-gram); kind 1: a partition of the model's table of order n."""

    def ask(rows: Iterator[dict]) -> Iterator[dict]:
        for block in map(Block, rows):
            keys, inverse = block.distinct(n)
            marks = np.bincount(inverse, ~block.held).astype(np.uint64) * np.uint64(2) + (np.bincount(inverse, block.held) > 0)
            ends = cuts(keys, parts)
            for i in range(parts):
                some = slice(ends[i], ends[i + 1])
                yield {"bucket": i, "block": block.id, "keys": pack_keys(keys[some]), "marks": planes(marks[some])}

    def answer(rows: Iterator[dict]) -> Iterator[dict]:
        asked = sorted(((r["block"], r["keys"], r["marks"], r["bucket"]) for r in rows), key=lambda r: r[0])
        if not asked:
            return
        keys = [unpack_keys(r[1]) for r in asked]
        ends = np.cumsum([0] + [len(k) for k in keys])
        found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        marks = np.concatenate([unplanes(r[2], "<u8") for r in asked])
        counts = np.bincount(inverse, marks >> np.uint64(1), len(found)).astype(np.uint64)
        out = (counts * np.uint64(2) + (np.bincount(inverse, marks & np.uint64(1), len(found)) > 0).astype(np.uint64))[inverse]
        for i, r in enumerate(asked):
            yield {"kind": 0, "n": n, "bucket": r[3], "block": r[0], "counts": planes(out[ends[i] : ends[i + 1]])}
        seen = counts > 0
        of_counts = np.bincount(np.minimum(counts[seen], KEPT + 1).astype(int), minlength=KEPT + 2)[1 : KEPT + 1]
        yield {"kind": 1, "n": n, "bucket": asked[0][3], "keys": pack_keys(found[seen]), "counts": planes(counts[seen]), "types": int(seen.sum()), "total": int(counts.sum()), "counts_of_counts": of_counts.tolist()}

    sent = mapped(tokens, ask, "bucket int, block long, keys binary, marks binary").repartitionById(parts, F.col("bucket"))
    return mapped(sent, answer, _COUNTED)


def discount(of_counts: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """d(r) from the numbers of types seen 1, 2, ... times."""
    seen = [(np.log(r), np.log(n)) for r, n in enumerate(of_counts, 1) if n]
    slope = min(float(np.polyfit(*zip(*seen, strict=True), 1)[0]), -1.1) if len(seen) > 1 else -2.0
    first = np.array([0.0] + [(1 + 1 / r) ** (slope + 1) for r in range(1, TURING + 1)])
    for r in range(1, TURING + 1):
        n, more = of_counts[r - 1 : r + 1]
        if n and 0 < (r + 1) * more < r * n:
            first[r] = (r + 1) * more / (r * n)

    def d(counts: np.ndarray) -> np.ndarray:
        large = np.power(1 + 1 / np.maximum(counts, 1), slope + 1)
        return np.where(counts <= TURING, first[np.minimum(counts, TURING).astype(int)], large)

    return d


class Model:
    """The model's tables and numbers: what a block needs besides its answers."""

    def __init__(self, tables: list[DataFrame], train_docs: int):
        self.tables = tables  # by order: bucket, keys, counts
        totals = [t.agg(F.sum("types"), F.sum("total"), *(F.sum(F.col("counts_of_counts")[i]) for i in range(KEPT))).first() for t in tables]
        self.types, self.tokens, self.train_docs = totals[0][0] or 0, totals[0][1] or 0, train_docs
        self.discounts = [discount([x or 0 for x in t[2:]]) for t in totals]
        d = self.discounts[0]

        def mass(rows: Iterator[dict]) -> Iterator[dict]:
            for r in rows:
                c = unplanes(r["counts"], "<u8").astype(float)
                yield {"mass": float((d(c) * c).sum())}

        known = mapped(tables[0].select("counts"), mass, "mass double").agg(F.sum("mass")).first()[0] or 0.0
        self.unknown = 1 - known / self.tokens if self.tokens else 1.0

    def numbers(self) -> tuple:
        return self.tokens, self.types, self.train_docs, self.unknown, self.discounts


class Answered:
    """A block with the training counts of its n-grams."""

    def __init__(self, row: dict, order: int, numbers: tuple):
        self.block = b = Block(row)
        self.tokens, self.types, self.train_docs, self.unknown, self.d = numbers
        answers = sorted(row["answers"], key=lambda a: (a["n"], a["bucket"]))
        self.counts, self.also_held, self.base = [], [], []
        for n in range(1, order + 1):
            marks = np.concatenate([unplanes(a["counts"], "<u8") for a in answers if a["n"] == n])[b.distinct(n)[1]]
            c = (marks >> np.uint64(1)).astype(float)
            self.base.append(np.full(len(c), float(self.tokens)) if n == 1 else b.before(self.counts[-1], float(self.train_docs)))
            self.also_held.append((marks & np.uint64(1)).astype(bool))
            self.counts.append(c)

    def seen(self, n: int, where: np.ndarray) -> np.ndarray:
        """P of the seen n-grams that end at these tokens."""
        c = self.counts[n - 1][where]
        return self.d[n - 1](c) * c / self.base[n - 1][where]

    def asks(self, n: int) -> np.ndarray:
        """The held-out tokens that leave a known history of order n."""
        return np.flatnonzero(self.block.held & (self.counts[n - 1] == 0) & (self.base[n - 1] > 0))


def added(parts: list[tuple[np.ndarray, tuple[np.ndarray, ...]]]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The distinct keys, sorted, and the sums of their values."""
    if not parts:
        return np.zeros(0, np.uint64), (np.zeros(0),) * 3
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, tuple(np.bincount(inverse, np.concatenate(v), len(keys)) for v in zip(*(p[1] for p in parts), strict=True))


def weights(answered: DataFrame, n: int, numbers: tuple, parts: int, some: range) -> DataFrame:
    """n, bucket, block, weights: log10 alpha of the histories of order n, of some of the partitions, that
    a block asks for."""
    low, high = (-(-(i << 64) // parts) for i in (some.start, some.stop))

    def own(keys: np.ndarray) -> np.ndarray:
        return (keys >= np.uint64(low)) & (keys <= np.uint64(high - 1))

    def ask(rows: Iterator[dict]) -> Iterator[dict]:
        held: list[tuple] = []

        def send(block: int) -> Iterator[dict]:
            keys, (times, used, lower) = added(held)
            ends = cuts(keys, parts)
            for i in np.flatnonzero(np.diff(ends)).tolist():
                at = slice(ends[i], ends[i + 1])
                yield {"bucket": i, "block": block, "keys": pack_keys(keys[at]), "times": planes(times[at].astype("<u8")), "used": planes(used[at]), "lower": planes(lower[at])}
            held.clear()

        last = 0
        for r in rows:
            a = Answered(r, n, numbers)
            last, h = a.block.id, a.block.histories(n)
            give = np.flatnonzero(~a.block.held & a.block.before(a.also_held[n - 2], True) & own(h))
            held.append((h[give], (np.ones(len(give)), a.d[n - 1](a.counts[n - 1][give]), a.seen(n - 1, give) / a.counts[n - 1][give])))
            if sum(len(x[0]) for x in held) > HELD:
                yield from send(last)
            asked = np.unique(h[a.asks(n)])
            asked = asked[own(asked)]
            ends = cuts(asked, parts)
            for i in np.flatnonzero(np.diff(ends)).tolist():
                yield {"bucket": i, "block": last, "asked": pack_keys(asked[ends[i] : ends[i + 1]])}
        yield from send(last)

    def answer(rows: Iterator[dict]) -> Iterator[dict]:
        sent = sorted(rows, key=lambda r: r["block"])
        keys, (times, used, lower) = added([(unpack_keys(r["keys"]), (unplanes(r["times"], "<u8"), *(unplanes(r[c], "<f8") for c in ("used", "lower")))) for r in sent if r["keys"]])
        alpha = np.log10((1 - used / times) / (1 - lower))
        for r in sent:
            if r["asked"]:
                yield {"n": n, "bucket": r["bucket"], "block": r["block"], "weights": planes(alpha[np.searchsorted(keys, unpack_keys(r["asked"]))])}

    sent = mapped(answered, ask, "bucket int, block long, keys binary, times binary, used binary, lower binary, asked binary").repartitionById(parts, F.col("bucket"))
    return mapped(sent, answer, "n int, bucket int, block long, weights binary")


def scored(answered: DataFrame, order: int, numbers: tuple, kind) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                one = b.slice(at, 1)
                r = one.drop_columns(["doc_ids"]).to_pylist()[0]
                a = Answered(r, order, numbers)
                words_, block = a.counts[0], a.block
                base = np.log10((words_ + 0.5) / (a.tokens + 0.5 * (a.types + 1)))
                known = np.flatnonzero(words_)
                p = np.full(len(words_), np.log10(a.unknown))
                p[known] = np.log10(a.seen(1, known))
                given = sorted(r["weights"] or [], key=lambda w: (w["n"], w["bucket"]))
                for n in range(2, order + 1):
                    asks = a.asks(n)
                    if len(asks):
                        alpha = np.concatenate([unplanes(w["weights"], "<f8") for w in given if w["n"] == n])
                        p[asks] += alpha[np.unique(block.histories(n)[asks], return_inverse=True)[1]]
                    seen = np.flatnonzero(a.counts[n - 1])
                    p[seen] = np.log10(a.seen(n, seen))
                per_doc = lambda x: pa.array(np.add.reduceat(x, block.first))  # noqa: B023, E731
                cols = [one.column("doc_ids").flatten(), one.column("held").flatten(), pa.array(block.lengths), per_doc((words_ > 0).astype(np.int64)), per_doc(base), per_doc(p)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return answered.mapInArrow(run, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """df, written once in buckets of a key: joins by it do not send these rows again."""
    spark = df.sparkSession
    path, table = scratch(spark, name), name.replace("-", "_")
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "512"}):
        df.write.bucketBy(partitions(spark), key).option("path", path).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    out.stored_at, out.bucketed_as = path, table
    return out


def score(documents: DataFrame, held: Column, order: int = 3) -> DataFrame:
    """Every document's log10 probability under the model of those that are not held out."""
    spark, name = documents.sparkSession, "katz-" + uuid.uuid4().hex[:6]
    parts = partitions(spark)
    tokens = bucketed(token_blocks(documents, held), "block", name)
    train_docs = tokens.agg(F.sum("train_docs")).first()[0] or 0
    levels = [materialize(counted(tokens, n, parts), f"{name}-{n}", FEW) for n in range(1, order + 1)]
    model = Model([t.filter("kind = 1") for t in levels], train_docs)

    def answered(n: int) -> DataFrame:
        """The blocks with their answers up to order n: a row a block on either side."""
        rows = reduce(DataFrame.unionAll, [t.filter("kind = 0") for t in levels[:n]])
        by_block = rows.select("block", F.struct("n", "bucket", "counts").alias("a")).groupBy("block").agg(F.collect_list("a").alias("answers"))
        return tokens.join(by_block, "block")

    # Orders over two go in two rounds, so that half of their sums lie in shuffle files at once.
    cut = lambda n: (0, parts) if n < 3 else (0, parts // 2, parts)
    rounds = [(n, range(a, b)) for n in range(2, order + 1) for a, b in pairwise(cut(n))]
    found = [materialize(weights(answered(n), n, model.numbers(), parts, some), f"{name}-weights-{n}", FEW) for n, some in rounds if some]
    given = answered(order).withColumn("weights", F.lit(None).cast("array<struct<n:int,bucket:int,weights:binary>>"))
    if found:
        by_block = reduce(DataFrame.unionAll, found).groupBy("block").agg(F.collect_list(F.struct("n", "bucket", "weights")).alias("weights"))
        given = given.drop("weights").join(by_block, "block", "left")
    out = materialize(scored(given, order, model.numbers(), documents.schema["doc_id"].dataType), name + "-scores", FEW)
    spark.sql(f"DROP TABLE {tokens.bucketed_as}")
    discard(tokens, *found)
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def op12_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return score(documents, held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
