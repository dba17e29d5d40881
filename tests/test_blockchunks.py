"""Chunks found in blocks against those of whole contents."""

import hashlib
import os
import random

import pytest

from concordat.operators import blockchunks
from concordat.operators.chunking import ChunkConfig, chunk_sizes
from concordat.sources import tree


@pytest.mark.parametrize("bits,block", [(7, 1000)])
def test_blocks_give_the_same_chunks(spark, tmp_path, bits, block, monkeypatch):
    monkeypatch.setattr(blockchunks, "NEAR", 1500)
    g = random.Random(bits)
    files = {f"f{i}": g.randbytes(n) for i, n in enumerate([1, 62, 63, 64, 65, 1000, 20_000])}
    files |= {"empty": b"", "same": b"A" * 9000, "cycle": bytes(range(256)) * 60, "text": b"a line of text, repeated\n" * 700, "mixed": g.randbytes(3000) + b"\0" * 9000 + g.randbytes(3000)}
    for path, data in files.items():
        (tmp_path / path).write_bytes(data)
    config = ChunkConfig(bits=bits, most=3)
    got = {r.path: r.chunks for r in blockchunks.chunk_tree(tree.scan_tree(spark, str(tmp_path)), str(tmp_path), config, block=block).collect()}
    assert set(got) == set(files)
    for path, data in files.items():
        sizes = chunk_sizes(data, config)
        assert [c.size for c in got[path]] == sizes, path
        assert [c.offset for c in got[path]] == [sum(sizes[:i]) for i in range(len(sizes))]
        assert all(c.hash == hashlib.sha256(data[c.offset : c.offset + c.size]).hexdigest() for c in got[path])


def test_a_file_of_many_blocks_and_one_that_shrinks(spark, tmp_path):
    data = random.Random(1).randbytes(1 << 20)
    (tmp_path / "big").write_bytes(data * 20)  # 20 MB: three blocks
    (tmp_path / "gone").write_bytes(b"x" * 5000)
    rows = spark.createDataFrame([(r.node_idx, r.path, r.tp, r.size) for r in tree.scan_tree(spark, str(tmp_path)).collect()], "node_idx int, path string, tp string, size long")
    os.truncate(tmp_path / "gone", 100)
    got = {r.path: r.chunks for r in blockchunks.chunk_tree(rows, str(tmp_path), ChunkConfig(bits=16), "blake3").collect()}
    assert got["gone"] is None
    assert [c.size for c in got["big"]] == chunk_sizes(data * 20, ChunkConfig(bits=16)) and len({c.hash for c in got["big"]}) < len(got["big"]) / 4
