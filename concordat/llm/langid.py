"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary.  A
word's probability is the sum over all ways to cut it into pieces, found by a
forward recursion over its bytes; a text's is the product over its words.
Every byte is also a piece of low probability, so no word has none.  The
distributions are fitted by expectation-maximisation (forward-backward) on the
word counts of a bounded sample of labelled documents.

Words are runs of ASCII letters and non-ASCII characters, lower-cased A-Z, of
any length: text without spaces is one word, summed over all its segmentations
in a window of the longest piece.  A worker's table holds the scores of words of
up to ``TABLED`` bytes, so the recursion runs once for each.  Only the fit cuts
words: of over ``FIT_BYTES`` bytes, at characters, as its memory needs both passes.

Defined results for odd input: null texts and texts without a letter are
``und`` with score 1; a text that has letters is given a learned language even
if it is one word; of equally likely languages the first by name wins; if
nothing can be learned, all are ``und``; a document without doc_id is not learned
from and counts as held out; very long texts are read whole; repeated rows repeat
their results; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import small_batches
from .texthash import LOWER, PieceTable, Words, byte_class, mix, text_runs

_U = np.uint64
#: Documents of a language that are learned from, about, at any input size.
SAMPLE = 1500
TABLED = 40
FIT_BYTES = 4096
BYTE_FLOOR = 1e-7
SMOOTHING = 0.02
ROUNDS = 4
#: Words of a worker's table after which it is begun anew.
MOST_WORDS = 2_000_000

LETTERS = byte_class([(0x61, 0x7A), (0x80, 0xFF)])


def vocabulary(path: str) -> list[bytes]:
    """The lower-case letter pieces of a sentencepiece vocabulary; a word's begin is a space."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).replace("▁", " ").encode().lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    keep = [p for p in pieces if 1 < len(p.lstrip(b" ")) <= 20 and p.count(b" ") <= 1 and LETTERS[np.frombuffer(p.lstrip(b" "), np.uint8)].all()]
    return sorted(keep)


class Pieces:
    """The vocabulary as a hash table: piece 0 is no piece, 1 to 256 are the bytes."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = [b"", *(bytes([i]) for i in range(256)), *(p for p in pieces if len(p) > 1)]
        self.longest = max(map(len, self.pieces))
        ends = np.cumsum([len(p) for p in self.pieces])
        self.table = PieceTable(18)
        self.table.find(np.frombuffer(b"".join(self.pieces), np.uint8), np.append(0, ends[:-1]), ends)

    def find(self, b: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.maximum(self.table.lookup(b, begins, ends), 0)

    def ending(self, b: np.ndarray, begins: np.ndarray, sizes: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """[word, j - lo - 1, k - 1]: the piece of size k that ends after j bytes of a word, lo < j <= hi."""
        j, k = np.arange(lo + 1, hi + 1)[None, :, None], np.arange(1, self.longest + 1)[None, None, :]
        ok = (j >= k) & (j <= sizes[:, None, None])
        from_ = (begins[:, None, None] + (j - k))[ok]
        out = np.zeros(ok.shape, np.int32)
        out[ok] = self.find(b, from_, from_ + np.broadcast_to(k, ok.shape)[ok])
        return out

    def grid(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, int, dict[tuple[int, int], np.ndarray]]]:
        """(words' places, their length, {(end, size): piece numbers}) by word length."""
        sizes = np.array([len(w) for w in words])
        for m in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == m)
            for rows_ in np.array_split(rows, len(rows) // 2000 + 1):
                flat = np.frombuffer(b"".join(words[i] for i in rows_), np.uint8)
                base = np.arange(len(rows_)) * m
                cells = {}
                for j in range(1, m + 1):
                    for k in range(1, min(j, self.longest) + 1):
                        cells[j, k] = base + (j - k)
                found = self.find(flat, np.concatenate(list(cells.values())), np.concatenate([c + k for (_, k), c in cells.items()])).reshape(len(cells), len(rows_))
                yield rows_, m, {cell: f for cell, f in zip(cells, found, strict=True) if f.any()}


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def _log_sum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exp(x) over axis 1; -inf where all are."""
    top = x.max(axis=1, keepdims=True)
    top[~np.isfinite(top)] = 0
    return _log(np.exp(x - top).sum(axis=1)) + top[:, 0]


def forward_long(pieces: Pieces, words: list[bytes], probability: np.ndarray, block: int = 512) -> np.ndarray:
    """As forward, for words of any length: only the last ``longest`` sums are held,
    as logarithms; some words go side by side, a byte of each a step."""
    out, logs = np.empty((len(words), probability.shape[1])), _log(probability)
    order = np.argsort([-len(w) for w in words], kind="stable")
    for rows in np.array_split(order, len(order) // 64 + 1):
        if not len(rows):
            continue
        sizes = np.array([len(words[i]) for i in rows])
        flat, begins = np.frombuffer(b"".join(words[i] for i in rows), np.uint8), np.cumsum(sizes) - sizes
        last = np.full((len(rows), pieces.longest, probability.shape[1]), -np.inf)  # of j - 1, j - 2, ...
        last[:, 0] = 0
        for lo in range(0, int(sizes[0]), block):
            live = int((sizes > lo).sum())
            hi = min(lo + block, int(sizes[0]))
            found = pieces.ending(flat, begins[:live], sizes[:live], lo, hi)
            last = last[:live]
            for j in range(hi - lo):
                now = _log_sum(last + logs[found[:, j]])
                last = np.concatenate([now[:, None], last[:, :-1]], axis=1)
                done = np.flatnonzero(sizes[:live] == lo + j + 1)
                out[rows[done]] = now[done]
    return out


def expected_long(pieces: Pieces, word: bytes, count: float, probability: np.ndarray) -> np.ndarray:
    """As expected_counts, for one word of up to FIT_BYTES bytes."""
    n, longest, logs = len(word), pieces.longest, _log(probability)
    found = pieces.ending(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.array([n]), 0, n)[0]
    alpha, beta = np.full(n + longest, -np.inf), np.full(n + longest + 1, -np.inf)  # alpha[j + longest - 1], beta[j]
    alpha[longest - 1], beta[n] = 0, 0
    sizes = np.arange(1, longest + 1)
    for j in range(1, n + 1):
        alpha[j + longest - 1] = _log_sum((alpha[j + longest - 1 - sizes] + logs[found[j - 1]])[None])[0]
    spans = logs[found]
    for j in range(n - 1, -1, -1):
        k = sizes[: n - j]
        beta[j] = _log_sum((beta[j + k] + spans[j + k - 1, k - 1])[None])[0]
    before = alpha[np.arange(1, n + 1)[:, None] + longest - 1 - sizes]
    weight = count * np.exp(before + spans + beta[1 : n + 1, None] - alpha[n + longest - 1])
    return np.bincount(found.reshape(-1), weight.reshape(-1), len(pieces.pieces))


def forward(pieces: Pieces, words: list[bytes], probability: np.ndarray) -> np.ndarray:
    """log probability of each word (with its leading space), a column per language."""
    out = np.empty((len(words), probability.shape[1]))
    for rows, m, cells in pieces.grid(words):
        alpha = [np.ones((len(rows), probability.shape[1]))] + [0.0] * m
        for (j, k), found in cells.items():
            alpha[j] = alpha[j] + alpha[j - k] * probability[found]
        out[rows] = np.log(alpha[m])
    return out


def expected_counts(pieces: Pieces, words: list[bytes], counts: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """How often each piece is used in one language's words, over all their segmentations."""
    out = np.zeros(len(pieces.pieces))
    for rows, m, cells in pieces.grid(words):
        n = len(rows)
        alpha, beta = [np.ones(n)] + [np.zeros(n)] * m, [np.zeros(n)] * m + [np.ones(n)]
        for (j, k), found in cells.items():
            alpha[j] = alpha[j] + alpha[j - k] * probability[found]
        for (j, k), found in reversed(cells.items()):
            beta[j - k] = beta[j - k] + beta[j] * probability[found]
        weight = counts[rows] / alpha[m]
        for (j, k), found in cells.items():
            out += np.bincount(found, weight * alpha[j - k] * probability[found] * beta[j], len(out))
    return out


def _parts(word: bytes) -> list[bytes]:
    """A word in parts of up to FIT_BYTES bytes, cut before characters."""
    out, at = [], 0
    while len(word) - at > FIT_BYTES:
        to = at + FIT_BYTES
        while to > at + FIT_BYTES - 4 and word[to] & 0xC0 == 0x80:
            to -= 1
        out.append(word[at:to])
        at = to
    return [*out, word[at:]]


def fit(pieces: Pieces, words: list[bytes], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language."""
    tabled = np.array([len(w) <= TABLED for w in words], bool)
    short = [w for w in words if len(w) <= TABLED]
    long = [(p, float(n)) for w, n in zip(words, counts, strict=True) if len(w) > TABLED for p in _parts(w)]

    def smoothed(n: np.ndarray) -> np.ndarray:
        n = n + SMOOTHING
        n[0] = 0
        p = n / n.sum()
        p[1:257] = np.maximum(p[1:257], BYTE_FLOOR)
        return p

    p = smoothed(np.zeros(len(pieces.pieces)))
    for _ in range(rounds):
        n = expected_counts(pieces, short, counts[tabled], p) if short else np.zeros(len(pieces.pieces))
        for part, count in long:
            n += expected_long(pieces, part, count, p)
        p = smoothed(n)
    return p


class Model:
    """languages, the vocabulary's pieces, and probability[piece, language]."""

    def __init__(self, languages: list[str], pieces: Pieces, probability: np.ndarray):
        self.languages, self.pieces, self.probability = languages, pieces, probability
        self.begin()

    def begin(self) -> None:
        self.table, self.scores = PieceTable(), np.zeros((1 << 15, len(self.languages)), np.float32)

    def __getstate__(self):
        return self.languages, self.pieces.pieces[257:], self.probability

    def __setstate__(self, state):
        self.__init__(state[0], Pieces(state[1]), state[2])

    def word_scores(self, b: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log probabilities of words, from the table where they are known."""
        out, sizes = np.empty((len(begins), len(self.languages))), ends - begins
        words = lambda rows: [b" " + b_[i:j] for i, j in zip(begins[rows].tolist(), ends[rows].tolist(), strict=True)]
        short, long = np.flatnonzero(sizes <= TABLED), np.flatnonzero(sizes > TABLED)
        if self.table.known > MOST_WORDS:
            self.begin()
        found, new = self.table.find(b, begins[short], ends[short])
        b_ = b.tobytes() if len(new) or len(long) else b""
        if len(new):
            while self.table.known > len(self.scores):
                self.scores = np.append(self.scores, np.zeros_like(self.scores), axis=0)
            self.scores[self.table.known - len(new) : self.table.known] = forward(self.pieces, words(short[new]), self.probability)
        out[short] = self.scores[found]
        if len(long):
            out[long] = forward_long(self.pieces, words(long), self.probability)
        return out

    def totals(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(log probability per text and language, has a letter) of runs of texts."""
        for first, raw, offsets in text_runs(column):
            b, w, begins, ends = letter_runs(raw, offsets, first)
            scores = np.zeros((w.texts + 1, len(self.languages)))
            if len(begins):
                sums = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self.word_scores(b, begins, ends), axis=0, dtype=np.float64)])
                scores = sums[np.append(w.bounds(), len(begins))]
            ascii_letter = np.concatenate([[0], np.cumsum((b >= 0x61) & (b <= 0x7A))])[offsets]
            has = np.diff(ascii_letter) > 0
            for i in np.flatnonzero(~has):
                has[i] = any(map(str.isalpha, raw[offsets[i] : offsets[i + 1]].tobytes().decode()))
            yield np.diff(scores[: w.texts + 1], axis=0), has


def letter_runs(raw: np.ndarray, offsets: np.ndarray, first: int):
    """(bytes, words, begins, ends) of letter runs."""
    b = LOWER[raw]
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = LETTERS[b]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    seams = offsets[1:-1]
    seams = seams[(seams > 0) & (seams < len(b))]
    begins[seams], ends[seams - 1] = inside[1:-1][seams], inside[1:-1][seams - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, begins, side="right") - 1
    return b, Words(first, len(offsets) - 1, doc, mix(begins.astype(np.uint64))), begins, ends


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, n of rows (lang, text): counted per batch, then summed."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, counts = batch.column(0).to_pylist(), {}
            for first, raw, offsets in text_runs(batch.column(1)):
                b, w, begins, ends = letter_runs(raw, offsets, first)
                data = b.tobytes()
                for d, i, j in zip(w.doc.tolist(), begins.tolist(), ends.tolist(), strict=True):
                    key = langs[first + d], data[i:j]
                    counts[key] = counts.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, vocabulary_path: str, sample: int = SAMPLE) -> Model:
    """A model of rows (doc_id, lang, text); about ``sample`` documents of each
    language, chosen by a hash of doc_id, reach the driver as word counts."""
    labelled = labelled.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    pieces = Pieces(vocabulary(vocabulary_path))
    if not sizes:
        return Model([], pieces, np.zeros((len(pieces.pieces), 0)))
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))))
    chosen = labelled.filter((F.xxhash64("doc_id").bitwiseAND((1 << 30) - 1)) / float(1 << 30) < F.try_element_at(share, F.col("lang")))
    table = word_counts(chosen).toArrow()
    langs, words, n = np.array(table.column("lang").to_pylist()), np.array(table.column("word").to_pylist(), object), table.column("n").to_numpy()
    languages = sorted(sizes)
    columns = []
    for lang in languages:
        own = langs == lang
        columns.append(fit(pieces, [b" " + w for w in words[own]], n[own].astype(float)))
    return Model(languages, pieces, np.stack(columns, axis=1))


def predict(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with lang_pred and score; reads text only."""
    spark = documents.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # pieces x languages: no larger for a larger input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            names, best = [], []
            for totals, has in m.totals(batch.column(len(keep))):
                if m.languages:
                    odds = np.exp(totals - totals.max(axis=1, keepdims=True))
                    odds /= odds.sum(axis=1, keepdims=True)
                    names += [m.languages[i] if h else "und" for i, h in zip(odds.argmax(axis=1).tolist(), has.tolist(), strict=True)]
                    best += np.where(has, odds.max(axis=1), 1.0).tolist()
                else:
                    names += ["und"] * len(has)
                    best += [1.0] * len(has)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(best, pa.float64())], names=[*keep, "lang_pred", "score"])

    rows = documents.select(*keep, F.col("text"))
    kinds = StructType([*rows.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(run, kinds)


def predicted(documents: DataFrame, model: Model) -> DataFrame:
    """_d (the row) and _p (lang_pred, score), so that no name of documents clashes."""
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_d"), "text")
    return predict(rows, model, ["_d"]).select("_d", F.struct("lang_pred", "score").alias("_p"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_segmentation_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(documents.filter(~held_out()), vocabulary_path())
    rows = documents.select("doc_id", "text", held_out().alias("held_out"))
    return predict(rows, model, ["doc_id", "held_out"])


def known_languages(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """documents without those that have no language, or none of ``least`` score."""
    model = train(documents.filter(~held_out()), vocabulary_path())
    return predicted(documents, model).filter((F.col("_p.lang_pred") != "und") & (F.col("_p.score") >= least)).select("_d.*")
