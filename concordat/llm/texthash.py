"""Word and shingle hashes of Arrow string columns, vectorised over bytes.

A text never becomes Python objects: word boundaries come from byte classes,
and a word's hash starts from its length and takes in eight bytes a step, mixed
after each; words of over ``LONG`` bytes are hashed singly by XXH3.  Strings of
up to eight bytes and of one length never collide.  Texts are worked off in
runs of about ``RUN`` bytes, so memory is bounded by the run or the longest
single text.  ``PieceTable`` numbers byte strings and checks every hit on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

RUN = 1 << 18
_U = np.uint64

_ODD = 0x9E3779B97F4A7C15
#: Bytes beyond which a string is hashed singly.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits (the splitmix64 finalizer)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def byte_class(word_ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in word_ranges:
        out[a : b + 1] = True
    return out


#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing
ALNUM = byte_class([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """Words of consecutive texts: ``first`` is the row of text 0 in its batch."""

    first: int
    texts: int
    doc: np.ndarray  # the text of each word, from 0
    hash: np.ndarray
    stem: np.ndarray | None = None  # hashes of the words' first bytes

    def bounds(self) -> np.ndarray:
        """Where each text's words begin, and the end."""
        return np.searchsorted(self.doc, np.arange(self.texts + 1))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of k words within one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, window_hash(self.hash, at, k)


def window_hash(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each place on."""
    h = np.full(len(at), _U(k * _ODD & (1 << 64) - 1))
    for i in range(k):
        h = (h + words[at + i]) * _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
    return mix(h)


def text_runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of texts in them) of runs of a string column; nulls are empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, 4 * column.offset).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


#: The bytes of a little-endian number that a string of 0 to 8 bytes fills.
_FILLED = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _eights(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros after the end."""
    padded = np.zeros(len(b) + 8, np.uint8)
    padded[: len(b)] = b
    return np.ndarray((len(b) + 1,), "<u8", padded, strides=(1,))


def piece_hashes(b: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings from begins to ends."""
    return _hashes(b, _eights(b), begins, ends - begins)


def _hashes(b: np.ndarray, eights: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    h = mix((sizes.astype(np.uint64) + _U(1)) * _U(_ODD) ^ eights[begins] & _FILLED[np.minimum(sizes, 8)])
    todo, done = np.flatnonzero((sizes > 8) & (sizes <= LONG)), 8
    while len(todo):
        left = sizes[todo] - done
        h[todo] = mix(h[todo] * _U(_ODD) ^ eights[begins[todo] + done] & _FILLED[np.minimum(left, 8)])
        todo, done = todo[left > 8], done + 8
    for i in np.flatnonzero(sizes > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(b[begins[i] : begins[i] + sizes[i]], seed=0x5EED)
    return h


class PieceTable:
    """Numbers byte strings in the order in which they are first met.

    A hash only names the slots to look at: a hit must have the same length and
    the same bytes, so strings whose hashes collide keep numbers of their own.
    """

    def __init__(self, bits: int = 16):
        self.bits, self.known, self.used = bits, 0, 0
        self.slot, self.keys = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.uint64)
        room = 1 << bits - 1
        self.hash, self.head, self.tail = (np.zeros(room, np.uint64) for _ in range(3))
        self.size, self.place = np.zeros(room, np.int32), np.zeros(room, np.int64)
        self.pool = np.zeros(1 << 16, np.uint8)  # the bytes of strings of over 16 bytes

    def find(self, b: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the numbers of the strings, the rows of those met first, in the order of their numbers)."""
        eights, sizes = _eights(b), ends - begins
        h = _hashes(b, eights, begins, sizes)
        head, tail = eights[begins] & _FILLED[np.minimum(sizes, 8)], eights[np.maximum(begins, ends - 8)]
        tail[sizes <= 8] = 0
        out, fresh, todo = np.empty(len(h), np.int32), [np.zeros(0, np.int64)], np.arange(len(h))
        while len(todo):
            todo = self._probe(b, begins, sizes, h, head, tail, todo, out)
            if len(todo):
                # Unequal strings of one hash come round again, one at a time.
                rows = todo[np.sort(np.unique(h[todo], return_index=True)[1])]
                out[rows] = self._add(b, begins, sizes, h, head, tail, rows)
                fresh.append(rows)
                left = np.ones(len(h), bool)
                left[rows] = False
                todo = todo[left[todo]]
        return out, np.concatenate(fresh)

    def lookup(self, b: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The numbers of the strings, -1 for unknown ones."""
        eights, sizes = _eights(b), ends - begins
        head, tail = eights[begins] & _FILLED[np.minimum(sizes, 8)], eights[np.maximum(begins, ends - 8)]
        tail[sizes <= 8] = 0
        out = np.full(len(sizes), -1, np.int32)
        self._probe(b, begins, sizes, _hashes(b, eights, begins, sizes), head, tail, np.arange(len(sizes)), out)
        return out

    def _probe(self, b, begins, sizes, h, head, tail, todo, out) -> np.ndarray:
        """Fills out for known rows of todo and returns the others."""
        at, missing = (h[todo] >> _U(64 - self.bits)).astype(np.int64), []
        while len(todo):
            slot = self.slot[at]
            hit = (slot >= 0) & (self.keys[at] == h[todo])
            n = slot[hit]
            rows = todo[hit]
            hit[hit] = same = (self.size[n] == sizes[rows]) & (self.head[n] == head[rows]) & (self.tail[n] == tail[rows])
            n, rows = n[same], rows[same]
            long = np.flatnonzero(sizes[rows] > 16)
            if len(long):
                wrong = long[~_same_bytes(b, begins[rows[long]], self.pool, self.place[n[long]], sizes[rows[long]])]
                if len(wrong):
                    hit[np.flatnonzero(hit)[wrong]] = False
            out[todo[hit]] = slot[hit]
            missing.append(todo[slot < 0])
            go = ~hit & (slot >= 0)
            todo, at = todo[go], at[go] + 1 & len(self.keys) - 1
        return np.sort(np.concatenate(missing)) if missing else todo

    def _add(self, b, begins, sizes, h, head, tail, rows) -> np.ndarray:
        while self.known + len(rows) > len(self.hash):
            self.bits += 1
            self.slot, self.keys = np.full(1 << self.bits, -1, np.int32), np.zeros(1 << self.bits, np.uint64)
            for name in ("hash", "head", "tail", "size", "place"):
                x = getattr(self, name)
                setattr(self, name, np.append(x, np.zeros_like(x)))
            self._insert(np.arange(self.known, dtype=np.int32))
        numbers = np.arange(self.known, self.known + len(rows), dtype=np.int32)
        self.hash[numbers], self.head[numbers], self.tail[numbers], self.size[numbers] = h[rows], head[rows], tail[rows], sizes[rows]
        long = np.flatnonzero(sizes[rows] > 16)
        if len(long):
            lengths, firsts = sizes[rows[long]], begins[rows[long]]
            ends = np.cumsum(lengths)
            while self.used + ends[-1] > len(self.pool):
                self.pool = np.append(self.pool, np.zeros(len(self.pool), np.uint8))
            self.place[numbers[long]] = self.used + ends - lengths
            self.pool[self.used : self.used + ends[-1]] = b[np.repeat(firsts - (ends - lengths), lengths) + np.arange(ends[-1])]
            self.used += int(ends[-1])
        self.known += len(rows)
        self._insert(numbers)
        return numbers

    def _insert(self, todo: np.ndarray) -> None:
        at = (self.hash[todo] >> _U(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]  # of those that want a slot the last gets it
            self.keys[at[free]] = self.hash[self.slot[at[free]]]
            go = self.slot[at] != todo
            todo, at = todo[go], at[go] + 1 & len(self.keys) - 1


def _same_bytes(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether a's strings from at equal b's from bt, sizes bytes each (1 at least)."""
    starts = np.cumsum(sizes) - sizes
    steps = np.arange(int(sizes.sum()))
    equal = a[np.repeat(at - starts, sizes) + steps] == b[np.repeat(bt - starts, sizes) + steps]
    return np.logical_and.reduceat(equal, starts)


def words(column: pa.Array, word: np.ndarray, stem: int = 0) -> Iterator[Words]:
    """The words of a string column (nulls: none), in runs of texts; with stem,
    also the hashes of their first so many bytes."""
    for first, raw, offsets in text_runs(column):
        yield _words(raw, offsets, first, word, stem)


def _words(raw: np.ndarray, offsets: np.ndarray, first: int, word: np.ndarray, stem: int) -> Words:
    b = LOWER[raw]
    inside = np.empty(len(b) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = word[b]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    seams = offsets[1:-1]
    seams = seams[(seams > 0) & (seams < len(b))]  # a word never crosses from text to text
    begins[seams] = inside[1:-1][seams]
    ends[seams - 1] = inside[1:-1][seams - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, begins, side="right") - 1
    stems = mix(piece_hashes(b, begins, np.minimum(ends, begins + stem))) if stem else None
    return Words(first, len(offsets) - 1, doc, piece_hashes(b, begins, ends), stems)


def shingle_sets(column: pa.Array, k: int, word: np.ndarray = NOT_SPACE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct k-word shingles of each text); a text of fewer
    words is one shingle, one without words an empty set."""
    for w in words(column, word):
        at, h = w.shingles(k)
        bounds, cuts = w.bounds(), np.searchsorted(w.doc[at], np.arange(w.texts + 1))
        sets = []
        for i in range(w.texts):
            n = bounds[i + 1] - bounds[i]
            if n >= k:
                sets.append(np.unique(h[cuts[i] : cuts[i + 1]]))
            elif n:
                sets.append(window_hash(w.hash, bounds[i : i + 1], int(n)))
            else:
                sets.append(np.zeros(0, np.uint64))
        yield w.first, sets
