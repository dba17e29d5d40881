"""BLAKE3 against its published vectors."""

import pytest
from pyspark.sql import functions as F

from concordat.functions.blake3 import blake3, digests
from concordat.operators import chunking

#: Published: bytes 0, 1, ... 250, 0, ... of a length, and its digest (fixed values).
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
    2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
    102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
}


def made(n):
    return bytes(i % 251 for i in range(n))


def test_published_vectors():
    assert [d.hex() for d in digests([made(n) for n in VECTORS])] == list(VECTORS.values())
    assert digests([b"abc"])[0].hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert digests([]) == []


def test_batches_do_not_mix():
    sizes = [0, 1, 63, 64, 65, 1023, 1024, 1025, 3000, 5121, 7168, 7169, 20_000]
    assert digests([made(n) for n in sizes]) == [digests([made(n)])[0] for n in sizes]


def test_column_and_chunks(spark):
    df = spark.createDataFrame([(0, "a", made(102400)), (0, "b", b""), (1, "c", None)], "node_idx int, path string, content binary")
    got = {r.path: r.d for r in df.select("path", blake3(F.col("content")).alias("d")).collect()}
    assert got == {"a": VECTORS[102400], "b": VECTORS[0], "c": None}
    whole = chunking.cdc_chunks(df, chunking.ChunkConfig(bits=8, most=4), digest="blake3").filter("path = 'a'").first().chunks
    assert [c.hash for c in whole] == [digests([made(102400)[c.offset : c.offset + c.size]])[0].hex() for c in whole]
    with pytest.raises(ValueError):
        chunking.cdc_chunks(df, digest="md4")


def test_small_files_are_chunked_and_digested_together(spark):
    import random

    import pyarrow as pa

    g = random.Random(6)
    files = [bytes(g.choices(range(97, 123), k=g.choice([0, 1, 63, 64, 65, 900]))) for _ in range(400)] + [b"a" * 5000, b""]
    config = chunking.ChunkConfig(bits=6, most=4)
    assert chunking.chunks_of(files, config) == [chunking.chunk_sizes(f, config) for f in files]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(files)), pa.array(["x"] * len(files)), pa.array(files)], names=["node_idx", "path", "content"])
    assert [(first, len(held)) for first, held in chunking._groups(batch)] == [(0, len(files))]
    df = spark.createDataFrame([(0, str(i), f) for i, f in enumerate(files)], "node_idx int, path string, content binary")
    for r in chunking.cdc_chunks(df, config, "blake3", payloads=True).collect():
        whole = files[int(r.path)]
        assert b"".join(bytes(c.data) for c in r.chunks) == whole
        assert [c.offset for c in r.chunks] == [sum(c.size for c in r.chunks[:i]) for i in range(len(r.chunks))]
        assert [c.hash for c in r.chunks] == [d.hex() for d in digests([whole[c.offset : c.offset + c.size] for c in r.chunks])]
