"""Content-defined chunks of files of any size, found in blocks that are read in parallel.

Where a chunk may end depends on the 64 bytes before, and on the chunk's begin only while the
chunk is shorter than that.  So the far edges, which no begin changes, are found block by
block with a halo of 63 bytes.  The near ones are found for the begins that matter: the file's, one
after each far edge, and the cuts at the largest size where no far edge comes; from each
the near edges that follow one another are read from a few thousand bytes.  A file's
begins are then walked over its edges alone, some numbers for each chunk.  Where the walk comes to a begin that was not
foreseen (after a near edge cuts shift), the begin is asked for and the walk goes on in the
next round.  Chunks are read once more for their digests, each by one read of its own range.

The root must be reachable by every executor.  Files are taken with the size of the scan:
an unreadable or a shorter file has null chunks; empty files have none.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .chunking import DIGESTS, WINDOW, ChunkConfig, _edges

#: Bytes of a block, and bytes read from a begin for its near edges.
BLOCK, NEAR = 8 << 20, 4096
_KEY = ["node_idx", "path"]


def _read(root: str, path: str, at: int, size: int) -> bytes | None:
    try:
        with open(os.path.join(root, path), "rb") as f:
            f.seek(at)
            data = f.read(size)
        return data if len(data) == size else None
    except OSError:
        return None


def _sums(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    return np.concatenate([[0], np.cumsum(b)]), np.concatenate([[0], np.cumsum(b * np.arange(len(b)))])


def far_edges(data: bytes, bits: int) -> np.ndarray:
    """The last bytes of whole windows after which a chunk may end."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    sums, moments = _sums(data)
    at = np.arange(WINDOW - 1, len(data))
    return at[_edges(sums, moments, at, at - WINDOW + 1, bits)]


def near_ends(data: bytes, bits: int, last: bool) -> tuple[list[int], bool]:
    """The ends of the near chunks that follow one another from the data's begin, and whether the next
    begin has none; the data may stop short of that, unless it ends the file."""
    sums, moments = _sums(data)
    out, start = [], 0
    while True:
        near = np.arange(start, min(start + WINDOW - 1, len(data)))
        hit = near[_edges(sums, moments, near, np.full(len(near), start), bits)]
        if not len(hit):
            return out, last or start + WINDOW - 1 <= len(data)
        out.append(int(hit[0]) + 1)
        start = out[-1]


def walk(size: int, far: np.ndarray, known: dict[int, tuple[list[int], bool]], config: ChunkConfig) -> tuple[list[int], int | None]:
    """The chunks' ends as far as the begins are known, and the first unknown begin."""
    out, start = [], 0
    while start < size:
        if start not in known:
            return out, start
        ends, whole = known[start]
        if ends:
            out += [start + e for e in ends]
            start = out[-1]
            if not whole:
                continue
            if start >= size:
                break
        elif not whole:
            raise ValueError("a window is larger than what is read for near edges")
        stop = min(size, start + config.max_size)
        k = int(np.searchsorted(far, start + WINDOW - 1))
        start = int(far[k]) + 1 if k < len(far) and far[k] < stop else stop
        out.append(start)
    return out, None


def foreseen(size: int, far: np.ndarray, config: ChunkConfig, start: int = 0) -> list[int]:
    """A begin and the cuts that follow it until a far edge comes."""
    out = [start]
    while True:
        stop = out[-1] + config.max_size
        k = int(np.searchsorted(far, out[-1] + WINDOW - 1))
        if stop >= size or (k < len(far) and far[k] < stop):
            return out
        out.append(stop)


def chunk_tree(rows: DataFrame, root: str, config: ChunkConfig = ChunkConfig(), digest: str = "sha256", block: int = BLOCK) -> DataFrame:
    """node_idx, path, chunks of a scan's files (node_idx, path, tp, size)."""
    bits, digests = config.bits, DIGESTS[digest]
    files = stored(rows.filter("tp = 'F'").select("node_idx", "path", "size"), "chunk-files")
    ranges = files.filter("size > 0").select(*_KEY, "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("at"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, path, size, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                low = max(0, at - WINDOW + 1)
                data = _read(root, path, low, min(block, size - at) + at - low)
                edges = None if data is None else (far_edges(data, bits) + low).tolist()
                yield pa.RecordBatch.from_pylist([{"node_idx": node, "path": path, "size": size, "edges": edges}], schema=pa.schema([("node_idx", pa.int32()), ("path", pa.string()), ("size", pa.int64()), ("edges", pa.list_(pa.int64()))]))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    found = stored(ranges.repartition(parts).mapInArrow(find, "node_idx int, path string, size long, edges array<long>"), "chunk-far")
    bad = found.filter("edges IS NULL").select(*_KEY).distinct()
    far = found.join(bad, _KEY, "left_anti").groupBy(*_KEY, "size").agg(F.array_sort(F.flatten(F.collect_list("edges"))).alias("edges"))
    far = stored(far, "chunk-edges")  # a file's edges: one for each 2^bits bytes

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, path, size, edges in zip(*(c.to_pylist() for c in b.columns), strict=True):
                e = np.array(edges, np.int64)
                starts = sorted({s for f in [-1, *edges] if f + 1 < size for s in foreseen(size, e, config, f + 1)})
                yield pa.RecordBatch.from_pylist([{"node_idx": node, "path": path, "size": size, "starts": starts}], schema=pa.schema([("node_idx", pa.int32()), ("path", pa.string()), ("size", pa.int64()), ("starts", pa.list_(pa.int64()))]))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for node, path, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = min(NEAR, size - start)
                data = _read(root, path, start, n)
                ends, whole = near_ends(data, bits, start + n == size) if data is not None else ([], True)
                out.append({"node_idx": node, "path": path, "start": start, "ends": ends, "whole": whole})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("node_idx", pa.int32()), ("path", pa.string()), ("start", pa.int64()), ("ends", pa.list_(pa.int64())), ("whole", pa.bool_())]))

    def step(key, edges: pd.DataFrame, begins: pd.DataFrame) -> pd.DataFrame:
        size, e = int(edges["size"].iloc[0]), np.array(edges["edges"].iloc[0], np.int64)
        known = {int(s): ([int(x) for x in ends], bool(w)) for s, ends, w in zip(begins["start"], begins["ends"], begins["whole"], strict=True)}
        ends, unknown = walk(size, e, known, config)
        asked = [] if unknown is None else [s for s in foreseen(size, e, config, unknown) if s not in known]
        return pd.DataFrame({"node_idx": [key[0]], "path": [key[1]], "size": [size], "chunk_ends": [ends if unknown is None else []], "starts": [asked]})

    begins = None
    asked = far.mapInArrow(first, "node_idx int, path string, size long, starts array<long>")
    done = None
    while True:
        told = asked.select(*_KEY, "size", F.explode("starts").alias("start")).repartition(parts).mapInArrow(near, "node_idx int, path string, start long, ends array<long>, whole boolean")
        begins = stored(told if begins is None else begins.unionAll(told), "chunk-begins")
        open_ = far if done is None else far.join(asked.select(*_KEY), _KEY, "left_semi")
        now = open_.groupBy(*_KEY).cogroup(begins.groupBy(*_KEY)).applyInPandas(lambda k, a, b: step(k, a, b) if len(a) else pd.DataFrame(columns=["node_idx", "path", "size", "chunk_ends", "starts"]), "node_idx int, path string, size long, chunk_ends array<long>, starts array<long>")
        now = stored(now, "chunk-walk")
        ended = now.filter("size(starts) = 0").select(*_KEY, "chunk_ends")
        done = ended if done is None else done.unionAll(ended)
        asked = now.filter("size(starts) > 0").select(*_KEY, "size", "starts")
        if asked.isEmpty():
            break

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, path, at, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = _read(root, path, at, size)
                hash_ = None if data is None else digests([data])[0].hex()
                yield pa.RecordBatch.from_pylist([{"node_idx": node, "path": path, "offset": at, "size": size, "hash": hash_}], schema=pa.schema([("node_idx", pa.int32()), ("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("hash", pa.string())]))

    pieces = done.select(*_KEY, F.explode(F.transform("chunk_ends", lambda x, i: F.struct(F.when(i == 0, 0).otherwise(F.get("chunk_ends", i - 1)).cast("long").alias("offset"), x.alias("end")))).alias("c"))
    pieces = pieces.select(*_KEY, "c.offset", (F.col("c.end") - F.col("c.offset")).alias("size")).repartition(parts)
    named = pieces.mapInArrow(name, "node_idx int, path string, offset long, size long, hash string")
    chunks = named.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("offset", "size", "hash"))).alias("c"))
    chunks = chunks.select(*_KEY, F.when(F.forall("c", lambda x: x["hash"].isNotNull()), F.transform("c", lambda x: F.struct(x["hash"].alias("hash"), x["offset"].alias("offset"), x["size"].alias("size")))).alias("chunks"))
    empty = F.when(F.col("size") == 0, F.array().cast("array<struct<hash:string,offset:long,size:long>>"))
    return files.join(chunks, _KEY, "left").select(*_KEY, F.coalesce("chunks", empty).alias("chunks"))
