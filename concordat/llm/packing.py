"""Concatenate-and-cut packing into fixed token windows.

Pass one tokenizes each document once, in ascending doc_id order within range
partitions, and stores ids, counts and partition-local starts.  The partition
totals' prefix sums then give every document its global offset, and pass two
cuts at each multiple of the window.  Only the last window is short.

Defined results for odd input: a null or empty text is the end id alone;
repeated rows are documents of their own; rows of one doc_id follow each other in
any order; an empty table has no pieces; a text of over half a billion tokens fails
(2 GB a value), shorter ones are cut whole; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize
from .tokens import part_offsets, tokenized, unpack

WINDOW = 2048


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW, lower: bool = False, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and with ``with_ids`` the ids; boundary records are the pieces with start > 0
    or start + length < doc_tokens."""
    stored = materialize(tokenized(documents, tokenizer, lower), "packing-tokens")
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    placed = stored.join(F.broadcast(part_offsets(totals)), "part")  # one row per partition
    placed = placed.select("doc_id", (F.col("part_start") + F.col("local_start")).alias("first"), "n_tokens", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, (first, n, ids) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                wide = np.ascontiguousarray(unpack(ids, len(ids) // n), "<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(first + start, window)
                    length = min(window - offset, n - start)
                    piece = wide[start : start + length].tobytes()
                    rows.append((at, start, length, zlib.crc32(piece), n, sequence, offset, piece if with_ids else None))
                    start += length
            cols = list(zip(*rows, strict=True)) or [()] * 8
            out = [batch.column(0).take(pa.array(cols[0], pa.int64()))] + [pa.array(c, pa.int64()) for c in cols[1:7]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                out.append(pa.array(cols[7], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=names + ["ids"] * with_ids)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)


def op5_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(documents, public_tokenizers.path("byte_bpe_50k.json"))
