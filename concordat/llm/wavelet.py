"""Token ids as wavelet matrices: one compressed file per shard.

A shard holds consecutive documents.  Its file has one bit-plane per token
bit, most significant first; each plane lists the tokens' bits in the order
in which the planes above have stably sorted them (zeros first).  Sampled
ranks per 512 bits make access, counting and occurrence lookup cost a few
steps per plane, without decoding the shard.

Layout: ``WVM1``, header length (u32), JSON header, then the compressed
sections that the header lists: document ids, document lengths, and per plane
its bits and its rank samples.

Defined results for odd input: a null text is the end id alone; repeated rows
are documents of their own; rows of one doc_id follow each other in any order; an
empty table writes no file; null doc_ids come first; a doc_id that is no whole number
of 64 bits fails; a text of over half a billion tokens fails (2 GB a value); extra
columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, open_fs, publish, scratch
from .tokens import Encoder, in_doc_order, part_offsets

MAGIC = b"WVM1"
BLOCK = 512
NULL_ID = -(1 << 63)


def _codec():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def build(tokens: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, bits: int) -> bytes:
    """The file of one shard."""
    squeeze = _codec()[0]
    sections, zeros, x = [squeeze.compress(np.asarray(doc_ids, "<i8").tobytes()), squeeze.compress(np.asarray(lengths, "<i8").tobytes())], [], tokens
    for b in reversed(range(bits)):
        plane = (x & x.dtype.type(1 << b)) != 0
        packed = np.packbits(plane, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(packed.view("<u8")).reshape(-1, BLOCK // 64).sum(axis=1)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        # By places: masks of mixed bits cost several times as much.
        low = x.take(np.flatnonzero(~plane))
        zeros.append(len(low))
        x = np.concatenate([low, x.take(np.flatnonzero(plane))])
        sections += [squeeze.compress(packed.tobytes()), squeeze.compress(ranks.tobytes())]
    head = json.dumps({"n": len(tokens), "docs": len(doc_ids), "bits": bits, "zeros": zeros, "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections])


class Shard:
    """Queries on one shard's file; planes are decompressed when first used."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        (n,) = struct.unpack_from("<I", data, 4)
        self.head = json.loads(data[8 : 8 + n])
        self.n, self.bits, self.zeros = self.head["n"], self.head["bits"], self.head["zeros"]
        self.data, self.open = data, _codec()[1]
        self.at = np.cumsum([8 + n, *self.head["sections"]])
        self.planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.doc_ids = np.frombuffer(self._section(0), "<i8")
        self.lengths = np.frombuffer(self._section(1), "<i8")

    def _section(self, k: int) -> bytes:
        return self.open.decompress(self.data[self.at[k] : self.at[k + 1]])

    def plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self.planes:
            self.planes[level] = np.frombuffer(self._section(2 + 2 * level), np.uint8), np.frombuffer(self._section(3 + 2 * level), "<u4")
        return self.planes[level]

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        packed, ranks = self.plane(level)
        block = i // BLOCK
        bits = np.unpackbits(packed[block * BLOCK // 8 : (i + 7) // 8], bitorder="little")[: i - block * BLOCK]
        return int(ranks[block]) + int(bits.sum())

    def _bit(self, level: int, i: int) -> int:
        return int(self.plane(level)[0][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            ones = self._rank1(level, i)
            token = token << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return token

    def _span(self, token: int, start: int, stop: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._rank1(level, start), self._rank1(level, stop)
            if token >> (self.bits - 1 - level) & 1:
                start, stop = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """Occurrences of a token in places start to stop."""
        if token >> self.bits:
            return 0
        a, b = self._span(token, start, self.n if stop is None else stop)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of a kind in a plane."""
        packed, ranks = self.plane(level)
        before = ranks if bit else np.arange(len(ranks)) * BLOCK - ranks.astype(np.int64)
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(packed[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def occurrence(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of a token; IndexError if there are fewer."""
        if token >> self.bits or k < 0:
            raise IndexError(k)
        start, stop = self._span(token, 0, self.n)
        if k >= stop - start:
            raise IndexError(k)
        i = start + k
        for level in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All tokens: the planes' sorts undone from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for level in reversed(range(self.bits)):
            ones = np.unpackbits(self.plane(level)[0], count=self.n, bitorder="little").view(bool)
            y = np.empty(self.n, kind)
            y[np.flatnonzero(~ones)] = x[: self.zeros[level]]
            y[np.flatnonzero(ones)] = x[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            x = y
        return x


def write_shards(documents: DataFrame, folder: str, tokenizer: str, lower: bool = True, shard_tokens: int = 1 << 21) -> DataFrame:
    """Tokenize and write; returns the manifest: part, shard, uri, docs, tokens, bytes.

    A shard ends with the run of texts (about 1 MB, or one longer text) that
    brings it to ``shard_tokens``, which bounds a task's memory at any partition size.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.get(tokenizer, lower), TaskContext.get().partitionId()
        bits = max(1, (max(encoder.tokenizer.get_vocab_size(), 2) - 1).bit_length())
        done, ids, sizes, docs, held = [], [], [], [], 0

        def flush():
            nonlocal ids, sizes, docs, held
            tokens, lengths = np.concatenate(ids), np.concatenate(sizes)
            data = build(tokens, np.concatenate(docs), lengths, bits)
            uri = f"{folder}/part-{part:06d}-{len(done):05d}.wvm"
            publish(uri, lambda out: out.write(data))
            done.append((part, len(done), uri, len(lengths), len(tokens), len(data)))
            ids, sizes, docs, held = [], [], [], 0

        for batch in batches:
            names, at = batch.column(0).cast(pa.int64()).fill_null(NULL_ID).to_numpy(), 0
            for counts, run in encoder.column(batch.column(1)):
                ids.append(run)
                sizes.append(counts)
                docs.append(names[at : at + len(counts)])
                at, held = at + len(counts), held + len(run)
                if held >= shard_tokens:
                    flush()
        if ids:
            flush()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=["part", "shard", "uri", "docs", "tokens", "bytes"])

    return materialize(in_doc_order(documents).mapInArrow(write, "part int, shard int, uri string, docs long, tokens long, bytes long"), "wavelet-manifest")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with each shard's global start, by two-pass prefix sums."""
    offsets = part_offsets(manifest.groupBy("part").agg(F.sum("tokens").alias("total")))
    w = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    local = manifest.withColumn("local", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    return local.join(F.broadcast(offsets), "part").withColumn("start", F.col("part_start") + F.col("local"))  # one row per partition


def read_documents(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = open_fs(uri)
                with fs.open_input_file(path) as f:
                    shard = Shard(f.read())
                wide = shard.decode().astype("<u4").tobytes()
                ends = np.cumsum(shard.lengths)
                starts = ends - shard.lengths
                slices = [wide[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array([None if d == NULL_ID else d for d in shard.doc_ids.tolist()], pa.int64()), pa.array(starts + first), pa.array(shard.lengths), pa.array([zlib.crc32(s) for s in slices], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(slices, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=names + ["ids"] * with_ids)

    n = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))
    files = shard_starts(manifest).select("uri", "start").repartition(n)
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op6_wavelet_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_shards(documents, scratch(spark, "wavelet"), public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, manifest)
