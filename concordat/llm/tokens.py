"""Token ids of whole texts, and documents in a global order.

A text is cut at points where the tokenizer itself always begins a new
pre-token: before a lone space or line feed between two visible characters.
Each distinct piece is encoded once by the tokenizers library; a worker's table
maps pieces, compared on their bytes, to ids, and whole columns are looked up at
once.  The result equals ``encode(text)`` with ``encode_special_tokens``: a text
that spells a special token holds ordinary text, as the tokenizers' notes have it.

A text's ids are one binary value, which Spark bounds by 2 GB: a single text of
over half a billion tokens fails.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, small_batches
from .texthash import LOWER, PieceTable, text_runs

END_ID = 1
#: Pieces of a worker's table (some 100 MB), and bytes of long ones, after which it is begun anew.
MOST_PIECES, MOST_BYTES = 1_500_000, 64 << 20

_encoders: dict[tuple[str, bool], Encoder] = {}

#: Bytes of visible characters, to be sure: no ASCII white space or control, and
#: none of the lead bytes under which other white space is found.
VISIBLE = np.ones(256, bool)
VISIBLE[:0x21] = VISIBLE[0x7F] = False
_WIDE_SPACE = {0xC2: 2, 0xE1: 3, 0xE2: 3, 0xE3: 3}


class Encoder:
    """Ids of columns of texts for one tokenizer file.

    ``lower``: the tokenizer lower-cases, so A-Z may be lower-cased before.
    """

    def __init__(self, path: str, lower: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.lower = lower
        # A piece of its own between others, whose single id marks their ends.
        (self.mark,) = self.tokenizer.encode("\0", add_special_tokens=False).ids
        self._begin()

    def _begin(self, bits: int = 18) -> None:
        self.table, self.learnt, self.used = PieceTable(bits), 0, 0
        self.first, self.length = np.zeros(1 << bits - 1, np.int32), np.zeros(1 << bits - 1, np.int32)
        self.pool = np.zeros(1 << 20, self.dtype)

    @classmethod
    def get(cls, path: str, lower: bool = False) -> Encoder:
        if (path, lower) not in _encoders:
            _encoders[path, lower] = cls(path, lower)
        return _encoders[path, lower]

    def column(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids per text, all ids) of runs of texts; each ends with the end id."""
        for _, raw, offsets in text_runs(column):
            yield self._run(LOWER[raw] if self.lower else raw, offsets)

    def ids(self, text: str | None) -> np.ndarray:
        return np.concatenate([ids for _, ids in self.column(pa.array([text], pa.string()))])[:-1]

    def _cuts(self, b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin; a text's begin is one."""
        visible = VISIBLE[b]
        for lead, n in _WIDE_SPACE.items():
            at = np.flatnonzero(b == lead)
            for i in range(n):
                visible[np.minimum(at + i, len(b) - 1)] = False
        cut = (b == 0x20) | (b == 0x0A)
        cut[:1] = cut[-1:] = False
        cut[1:-1] &= visible[:-2] & visible[2:]
        seams = offsets[:-1][offsets[:-1] < len(b)]
        cut[np.maximum(offsets[1:-1] - 1, 0)] = False  # a text's last byte never begins a piece
        cut[seams] = True
        return np.flatnonzero(cut)

    def _run(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = len(offsets) - 1
        if len(b):
            begins = self._cuts(b, offsets)
            ends = np.append(begins[1:], len(b))
            found = self._find(b, begins, ends)
            per_text = np.searchsorted(begins, offsets)
            lengths = self.length[found].astype(np.int64)
        else:
            found, per_text, lengths = np.zeros(0, np.int64), np.zeros(texts + 1, np.int64), np.zeros(0, np.int64)
        ends_at = np.concatenate([[0], np.cumsum(lengths)])
        pieces = self.pool[np.repeat(self.first[found] - ends_at[:-1], lengths) + np.arange(ends_at[-1])]
        counts = np.diff(ends_at[per_text]) + 1
        out = np.empty(len(pieces) + texts, self.dtype)
        last = np.cumsum(counts) - 1
        inner = np.ones(len(out), bool)
        inner[last] = False
        out[inner], out[last] = pieces, END_ID
        return counts, out

    def _find(self, b: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The pieces' numbers; new pieces are encoded first."""
        if self.table.known > MOST_PIECES or self.table.used > MOST_BYTES:
            self._begin()
        found, new = self.table.find(b, begins, ends)
        if len(new):
            while self.table.known > len(self.first):
                self.first, self.length = (np.append(x, np.zeros(len(x), np.int32)) for x in (self.first, self.length))
            data = b.tobytes()
            self._learn([data[i:j].decode() for i, j in zip(begins[new].tolist(), ends[new].tolist(), strict=True)])
        return found

    def _learn(self, new: list[str]) -> None:
        """Encode pieces with one call, the mark between them; those that hold a NUL singly."""
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            marked = ["\0"] * (2 * len(part))
            marked[::2] = ["" if "\0" in p else p for p in part]
            ids = np.array(self.tokenizer.encode_batch_fast([marked], is_pretokenized=True, add_special_tokens=False)[0].ids, self.dtype)
            stops = np.flatnonzero(ids == self.mark)
            counts = np.diff(stops, prepend=-1) - 1
            ids = ids[ids != self.mark]
            if any("\0" in p for p in part):
                pieces = np.split(ids, np.cumsum(counts)[:-1])
                for i, p in enumerate(part):
                    if "\0" in p:
                        pieces[i] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, self.dtype)
                counts, ids = np.array([len(p) for p in pieces]), np.concatenate(pieces)
            while self.used + len(ids) > len(self.pool):
                self.pool = np.append(self.pool, np.zeros(len(self.pool), self.dtype))
            self.pool[self.used : self.used + len(ids)] = ids
            self.first[self.learnt : self.learnt + len(part)] = self.used + np.cumsum(counts) - counts
            self.length[self.learnt : self.learnt + len(part)] = counts
            self.learnt, self.used = self.learnt + len(part), self.used + len(ids)


def in_doc_order(documents: DataFrame) -> DataFrame:
    """doc_id, text: range-partitioned and sorted, so that partition number and
    place give the global order.  Equal ids are ordered by text; null ids first."""
    small_batches(documents.sparkSession, 256)
    rows = documents.select("doc_id", "text")
    return rows.repartitionByRange(partitions(documents.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())


def tokenized(documents: DataFrame, path: str, lower: bool = False) -> DataFrame:
    """part, doc_id, n_tokens, local_start (ids before it in its part), ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = Encoder.get(path, lower), TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for counts, ids in encoder.column(batch.column(1)):
                ends = np.cumsum(counts)
                edges = np.append(0, ends * encoder.dtype.itemsize).astype(np.int32)
                rows = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(edges), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(counts), part, np.int32)), batch.column(0).slice(at, len(counts)), pa.array(counts), pa.array(ends - counts + before), rows],
                    names=["part", "doc_id", "n_tokens", "local_start", "ids"],
                )
                at, before = at + len(counts), before + int(ends[-1])

    return in_doc_order(documents).mapInArrow(run, f"part int, doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens long, local_start long, ids binary")


def part_offsets(totals: DataFrame) -> DataFrame:
    """part, part_start from part, total: the second pass of the prefix sums.

    One row per partition: its size is bounded by the partition count.
    """
    from pyspark.sql import Window

    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(w), F.lit(0)).cast("long").alias("part_start"))


def unpack(ids: bytes, width: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if width == 2 else "<u4")


