import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from fixtures import DOCS, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from concordat.llm import packing, texthash, tokens, wavelet
from concordat.llm.shared import scratch
from concordat.llm.tokens import Encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
_plain = {}


def plain(path, text):
    if path not in _plain:
        _plain[path] = Tokenizer.from_file(path)
        _plain[path].encode_special_tokens = True
    return _plain[path].encode(text or "", add_special_tokens=False).ids


CASES = [(BYTES, False), (WORDS, True)]


@pytest.mark.parametrize(("path", "lower"), CASES)
def test_cut_encoding_equals_plain(path, lower):
    e = Encoder(path, lower)
    for _ in range(2):
        for _, text in DOCS:
            assert e.ids(text).tolist() == plain(path, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1.,!' \n\t\r\x00\x1c\x85\u3000\u0301éΣßA|É\u2028\xa0"), max_size=20), max_size=4))
def test_cut_encoding_equals_plain_on_any_texts(texts):
    for path, lower in CASES:
        for counts, flat in Encoder.get(path, lower).column(pa.array(texts, pa.string())):
            for text, ids in zip(texts, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                assert ids.tolist() == [*plain(path, text), 1]


def test_table_grows_and_begins_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PIECES", 5)
    e = Encoder(BYTES)
    e._begin(bits=2)
    for n in (3, 50, 7, 400):
        text = " ".join(f"w{i * n}" for i in range(n))
        assert e.ids(text).tolist() == plain(BYTES, text)


def thue_morse(n):
    x = np.zeros(1, np.uint8)
    while len(x) < n:
        x = np.concatenate([x, 1 - x])
    return "".join("ab"[i] for i in x), "".join("ba"[i] for i in x)


@pytest.mark.parametrize("n", [512, 1024, 2048, 8192])
def test_no_structured_collisions(n):
    a, b = thue_morse(n)
    for path, lower in CASES:
        e = Encoder(path, lower)
        for text in (a, b, f"{b} {a}"):
            assert e.ids(text).tolist() == plain(path, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=30), st.lists(st.binary(max_size=3), max_size=30))
def test_table_tells_strings_of_one_hash_apart(some, more):
    real = texthash._hashes
    for hashes in (real, lambda b, eights, begins, sizes: real(b, eights, begins, sizes) & np.uint64(1 << 63 | 1)):
        texthash._hashes = hashes
        try:
            table, numbers = texthash.PieceTable(2), {}
            for strings in (some, more, some + more):
                ends = np.cumsum([len(x) for x in strings], dtype=np.int64)
                begins = ends - np.array([len(x) for x in strings], np.int64)
                raw = np.frombuffer(b"".join(strings), np.uint8)
                got, new = table.find(raw, begins, ends)
                for i in new:
                    assert strings[i] not in numbers
                    numbers[strings[i]] = len(numbers)
                assert got.tolist() == [numbers[x] for x in strings]
                assert table.lookup(raw, begins, ends).tolist() == got.tolist()
        finally:
            texthash._hashes = real


def ordered():
    return sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pack_is_concatenate_and_cut(spark):
    window = 64
    got = packing.pack(documents(spark), BYTES, window, with_ids=True).collect()
    expected, at = [], 0
    for doc_id, text in ordered():
        ids, start = [*plain(BYTES, text), 1], 0
        while start < len(ids):
            n = min(window - at % window, len(ids) - start)
            expected.append((doc_id, start, n, crc(ids[start : start + n]), len(ids), at // window, at % window))
            start, at = start + n, at + n
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(expected, key=repr)
    assert all(crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 for r in got)


def test_wavelet_round_trip_through_files(spark):
    manifest = wavelet.write_shards(documents(spark), scratch(spark, "t"), WORDS, shard_tokens=100)
    got = wavelet.read_documents(spark, manifest).collect()
    expected, at = [], 0
    for doc_id, text in ordered():
        ids = [*plain(WORDS, text), 1]
        expected.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)
    assert manifest.count() > 1


def test_empty_tables(spark):
    none = documents(spark).filter("false")
    assert packing.pack(none, BYTES).count() == 0
    assert wavelet.read_documents(spark, wavelet.write_shards(none, scratch(spark, "t"), WORDS)).count() == 0


@pytest.mark.parametrize("n", [1, 511, 512, 513, 3000])
def test_wavelet_access_count_and_occurrence(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 40, n).astype(np.uint16)
    s = wavelet.Shard(wavelet.build(x, np.array([5]), np.array([n]), 6))
    assert s.decode().tolist() == x.tolist()
    for i in rng.integers(0, n, 20).tolist() + [0, n - 1]:
        assert s.access(i) == x[i]
    for t in (0, int(x[0]), 39, 45, 63, 64):
        places = np.flatnonzero(x == t)
        assert s.count(t) == len(places)
        assert s.count(t, n // 3, n // 2) == ((places >= n // 3) & (places < n // 2)).sum()
        for k in range(0, len(places), 7):
            assert s.occurrence(t, k) == places[k]
        with pytest.raises(IndexError):
            s.occurrence(t, len(places))


def test_planes_of_mixed_bits_cost_less_than_masks():
    x = np.random.default_rng(5).integers(0, 1 << 16, 1 << 21).astype(np.uint16)

    def seconds(work):
        began = time.process_time()
        work()
        return time.process_time() - began

    def by_masks():
        for b in range(16):
            plane, y = (x & np.uint16(1 << b)) != 0, np.empty_like(x)
            low, high = x[~plane], x[plane]
            y[~plane], y[plane] = low, high

    def by_places():
        data = wavelet.build(x, np.arange(1), np.array([len(x)]), 16)
        assert np.array_equal(wavelet.Shard(data).decode(), x)

    assert min(seconds(by_places) for _ in range(2)) < min(seconds(by_masks) for _ in range(2))
