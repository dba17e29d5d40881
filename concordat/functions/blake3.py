"""BLAKE3-256 by its published specification, worked off as arrays.

All 1024-byte chunks of all inputs of a batch are compressed side by side, a block of 64
bytes at a time; then chaining values of neighbours are paired level by level, an odd last one
moving up, which is the tree that the specification asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the specification.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK, CHUNK, ROUNDS = 64, 1024, 7


def _schedule() -> np.ndarray:
    """The words of each round in the order they are mixed in: first and second ones of the columns, then of the diagonals."""
    order, out = np.arange(16), []
    for _ in range(ROUNDS):
        out += [order[i : i + 8 : 2] for i in (0, 1, 8, 9)]
        order = order[PERMUTATION]
    return np.concatenate(out)


SCHEDULE = _schedule()
#: Chunks compressed side by side: their state and a block of each stay in a core's cache.
SLAB = 2048


def _turn(x: np.ndarray, n: int, other: np.ndarray) -> None:
    """x turned right by n bits, in place."""
    np.left_shift(x, np.uint32(32 - n), out=other)
    np.right_shift(x, np.uint32(n), out=x)
    np.bitwise_or(x, other, out=x)


def compress(values: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values (8, n) after a block (16 words, n) each.

    The four columns, then the four diagonals, are mixed at once.  Rows of b, c and d have
    room beside them: for the diagonals the outer rows are copied to the other end.
    """
    n = values.shape[1]
    v = np.empty((20, n), np.uint32)
    a, b, c, d, other = v[:4], v[4:9], v[9:15], v[15:20], np.empty((4, n), np.uint32)
    a[:], b[:4], c[:4] = values[:4], values[4:], IV[:4, None]
    d[1], d[2], d[3], d[4] = counter & np.uint64(0xFFFFFFFF), counter >> np.uint64(32), length, flags
    words = words[SCHEDULE]

    def mix(b: np.ndarray, c: np.ndarray, d: np.ndarray, words: np.ndarray) -> None:
        for half, right, left in ((words[:4], 16, 12), (words[4:], 8, 7)):
            np.add(a, b, out=a)
            np.add(a, half, out=a)
            np.bitwise_xor(d, a, out=d)
            _turn(d, right, other)
            np.add(c, d, out=c)
            np.bitwise_xor(b, c, out=b)
            _turn(b, left, other)

    for i in range(0, 16 * ROUNDS, 16):
        mix(b[:4], c[:4], d[1:], words[i : i + 8])
        b[4], c[4:], d[0] = b[0], c[:2], d[4]
        mix(b[1:], c[2:], d[:4], words[i + 8 : i + 16])
        b[0], c[:2], d[4] = b[4], c[4:], d[0]
    return np.concatenate([a ^ c[:4], b[:4] ^ d[1:]])


def _chunks(data: np.ndarray, at: np.ndarray, sizes: np.ndarray, counter: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Chaining values (8, n) of chunks; one that is alone is the root."""
    blocks = np.maximum(1, -(-sizes // BLOCK))
    longest = np.argsort(-blocks, kind="stable")  # those that still have blocks come first
    at, sizes, counter, alone, blocks = at[longest], sizes[longest], counter[longest], alone[longest], blocks[longest]
    width = BLOCK * int(blocks.max(initial=0))
    padded = np.lib.stride_tricks.sliding_window_view(data, width)[at]
    padded *= np.arange(width) < sizes[:, None]
    words = np.ascontiguousarray(padded.view("<u4").T)
    values = np.repeat(IV[:, None], len(at), axis=1)
    for i in range(int(blocks.max(initial=0))):
        on = int(np.searchsorted(-blocks, -i))
        end = blocks[:on] == i + 1
        flags = (CHUNK_START * (i == 0) + CHUNK_END * end + ROOT * (end & alone[:on])).astype(np.uint32)
        length = np.where(end, sizes[:on] - BLOCK * i, BLOCK).astype(np.uint32)
        values[:, :on] = compress(values[:, :on], words[16 * i : 16 * i + 16, :on], counter[:on], length, flags)
    out = np.empty_like(values)
    out[:, longest] = values
    return out


def digests(contents: Sequence[bytes]) -> list[bytes]:
    """The 32-byte digests of a batch."""
    sizes = np.array([len(c) for c in contents], np.int64)
    if not len(sizes):
        return []
    data = np.frombuffer(b"".join([*contents, bytes(CHUNK)]), np.uint8)  # a whole chunk may be taken from any begin
    n = np.maximum(1, -(-sizes // CHUNK))
    of = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(sizes) - sizes, n) + number * CHUNK
    size = np.minimum(CHUNK, np.repeat(sizes, n) - number * CHUNK)
    alone = (n == 1)[of]
    parts = [_chunks(data, at[i : i + SLAB], size[i : i + SLAB], number[i : i + SLAB].astype(np.uint64), alone[i : i + SLAB]) for i in range(0, len(of), SLAB)]
    values = np.concatenate(parts, axis=1)
    while (n > 1).any():
        first = np.cumsum(n) - n
        spot = np.arange(len(of)) - first[of]
        left = np.flatnonzero((spot % 2 == 0) & (spot + 1 < n[of]))
        flags = (PARENT + ROOT * (n[of[left]] == 2)).astype(np.uint32)
        pairs = np.concatenate([values[:, left], values[:, left + 1]])
        values[:, left] = compress(np.repeat(IV[:, None], len(left), axis=1), pairs, np.zeros(len(left), np.uint64), np.full(len(left), BLOCK, np.uint32), flags)
        keep = spot % 2 == 0
        values, of, n = values[:, keep], of[keep], (n + 1) // 2
    return [row.tobytes() for row in np.ascontiguousarray(values.T).astype("<u4")]


def blake3(content: Column) -> Column:
    """The digest of a binary or string column as 64 hexadecimal letters; null for null."""

    @F.pandas_udf("string")
    def hexadecimal(batch: pd.Series) -> pd.Series:
        known = batch.notna()
        raw = [bytes(x) for x in batch[known]]
        out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
        out[known] = [d.hex() for d in digests(raw)]
        return out

    return hexadecimal(content.cast("binary"))
