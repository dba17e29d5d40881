"""Content-defined chunks by the published bup rolling checksum.

The checksum depends on the last 64 bytes since the chunk's begin, so a file's
candidate edges come from prefix sums; only the first 64 bytes after each edge
are computed anew.  Files are worked off a megabyte at a time, their digests together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import blake3

WINDOW, OFFSET = 64, 31


@dataclass(frozen=True)
class ChunkConfig:
    """2^bits bytes a chunk on average, 2^bits * most at most."""

    bits: int = 20
    most: int = 16

    def __post_init__(self):
        if not 1 <= self.bits <= 32 or self.most < 1:
            raise ValueError("bits must be within 1 and 32, and the maximum no less than the average")

    @property
    def max_size(self) -> int:
        return self.most << self.bits


def _edges(sums: np.ndarray, moments: np.ndarray, at: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """Whether a chunk may end after byte at, its window beginning at low."""
    s = sums[at + 1] - sums[low]
    s1 = WINDOW * OFFSET + s
    s2 = WINDOW * (WINDOW - 1) * OFFSET + (at + 1) * s - (moments[at + 1] - moments[low])
    mask = (1 << bits) - 1
    return ((s1 << 16 | s2 & 0xFFFF) & mask) == mask


#: Begins whose near edges are looked for together.
BEGINS = 1 << 12


def chunks_of(contents: list[bytes], config: ChunkConfig = ChunkConfig()) -> list[list[int]]:
    """Sizes of the consecutive chunks of each content; none for an empty one.

    The next chunk's end is found for all begins that can be foreseen (those of the contents and
    one after each far edge) at once, then for the ends among them that were not, until none is left.
    """
    bounds = np.cumsum([0, *map(len, contents)])
    n = int(bounds[-1])
    if not n:
        return [[] for _ in contents]
    b = np.frombuffer(b"".join(contents), np.uint8).astype(np.int64)
    sums, moments = np.concatenate([[0], np.cumsum(b)]), np.concatenate([[0], np.cumsum(b * np.arange(n))])
    of = lambda at: np.searchsorted(bounds, at, "right") - 1
    at = np.arange(WINDOW - 1, n)
    far = at[_edges(sums, moments, at, at - WINDOW + 1, config.bits)]
    far = far[far - WINDOW + 1 >= bounds[of(far)]]
    after = np.zeros(n, np.int64)  # the end of a chunk by its begin; 0: not known

    def ends(begins: np.ndarray) -> np.ndarray:
        stop = np.minimum(bounds[of(begins) + 1], begins + config.max_size)
        near = begins[:, None] + np.arange(WINDOW - 1)
        inside = near < stop[:, None]
        hit = _edges(sums, moments, np.minimum(near, n - 1), begins[:, None], config.bits) & inside
        k = np.searchsorted(far, begins + WINDOW - 1)
        edge = np.append(far, n)[k]
        return np.where(hit.any(axis=1), begins + hit.argmax(axis=1) + 1, np.where(edge < stop, edge + 1, stop))

    begins = np.unique(np.concatenate([bounds[:-1], far + 1]))
    begins = begins[begins < n]
    while len(begins):
        for i in range(0, len(begins), BEGINS):
            after[begins[i : i + BEGINS]] = ends(begins[i : i + BEGINS])
        begins = np.unique(after[begins])
        begins = begins[begins < n]
        begins = begins[after[begins] == 0]
    out = []
    for begin, end in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        sizes = []
        while begin < end:
            sizes.append(int(after[begin]) - begin)
            begin += sizes[-1]
        out.append(sizes)
    return out


def chunk_sizes(data: bytes, config: ChunkConfig = ChunkConfig()) -> list[int]:
    """Sizes of consecutive chunks that cover the data; none for no data."""
    return chunks_of([data], config)[0]


#: Digests of a list of contents, by name.
DIGESTS = {"sha256": lambda contents: [hashlib.sha256(c).digest() for c in contents], "blake3": blake3.digests}
#: Bytes of files chunked together, unless one file has more.
TOGETHER = 1 << 20


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, contents) of rows that follow one another, up to TOGETHER bytes."""
    first, held, total = 0, [], 0
    for at in range(batch.num_rows):
        content = batch.column(2)[at].as_py()
        data = content.encode() if isinstance(content, str) else content or b""
        if held and total + len(data) > TOGETHER:
            yield first, held
            first, held, total = at, [], 0
        held.append(data)
        total += len(data)
    if held:
        yield first, held


def cdc_chunks(files: DataFrame, config: ChunkConfig = ChunkConfig(), digest: str = "sha256", payloads: bool = False) -> DataFrame:
    """node_idx, path, chunks of files (node_idx, path, content: binary or string); payloads: chunks have their bytes (data)."""
    if digest not in DIGESTS:
        raise ValueError(f"unknown digest: {digest}")
    digests = DIGESTS[digest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hash", "offset", "size", *(["data"] if payloads else [])]
        for batch in batches:
            for first, contents in _groups(batch):
                sizes = chunks_of(contents, config)
                ends = [np.cumsum([0, *s]).tolist() for s in sizes]
                cut = [data[a:b] for data, e in zip(contents, ends, strict=True) for a, b in zip(e, e[1:], strict=False)]
                fields = [pa.array([h.hex() for h in digests(cut)], pa.string()), pa.array([o for e in ends for o in e[:-1]], pa.int64()), pa.array([n for s in sizes for n in s], pa.int64())]
                if payloads:
                    fields.append(pa.array(cut, pa.binary()))
                at = pa.array(np.cumsum([0, *map(len, sizes)]), pa.int32())
                chunks = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(fields, names=names))
                rows = batch.slice(first, len(contents))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), chunks], names=["node_idx", "path", "chunks"])

    kind = "hash:string,offset:long,size:long" + (",data:binary" if payloads else "")
    return files.select("node_idx", "path", "content").mapInArrow(run, f"node_idx int, path string, chunks array<struct<{kind}>>")
