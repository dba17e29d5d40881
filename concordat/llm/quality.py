"""Quality and toxicity from overlapping weak labellers.

Heuristics and a partial table of human labels each say 1, 0 or nothing of a
document.  Every document is counted by its pattern of votes; the patterns,
whose number the labellers bound, are all that expectation-maximisation needs
to estimate how each labeller errs and how likely each pattern's label is.
These posterior labels train a linear scorer over hashed words and binned
statistics, on a bounded sample of documents, and the scorer rates all.

Of a table larger than the sample, the documents that people have called toxic
come first, up to a third of the sample, shared by the languages, then those
they have called clean, up to a third too; the rest is drawn from all others.

Human labels of documents with crc32(doc_id) mod 5 = 0 are never used: they
are left for measurement.

Defined results for odd input: null, empty or word-less texts have quality 0
and toxicity 0 and are not kept; without human labels the heuristics alone
decide; several labels of one doc_id count as their maximum for toxicity and
minimum for quality; repeated rows repeat their results; an empty table gives
none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches
from .texthash import NOT_SPACE, Words, byte_class, mix, piece_hashes, text_runs, words

_U = np.uint64
#: Documents, about, that the scorer is trained on, at any input size.
SAMPLE = 12_000
FEATURE_BITS = 18
EPOCHS, STEP, PENALTY = 4, 0.3, 3.0
ROUNDS = 60

#: Bytes of a word that are its stem.
STEM = 6

#: Documents that must have a feature before it gets a weight, for
#: quality and for toxicity: rare words tell much of the latter, nothing of the former.
#: Quality counts in the sample; toxicity in all documents that people have labelled, if they are more.
LEAST_DOCUMENTS = (100, 5)

#: Insults (fixed values: a small public English list).
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")

_LETTER = byte_class([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
_UPPER = byte_class([(0x41, 0x5A)])
_PLAIN = byte_class([(0x20, 0x22), (0x27, 0x29), (0x2C, 0x3B), (0x3F, 0x3F), (0x09, 0x0D)]) | _LETTER
_END = byte_class([(0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F)])
_WORD = byte_class([(0x61, 0x7A), (0x80, 0xFF)])

#: (statistic, bad from, good to): a labeller says 0 at or over the one, 1 at or under the other.
HEURISTICS = (
    ("symbols", 0.08, 0.02),
    ("capitals", 0.40, 0.15),
    ("sameness", 0.80, 0.60),
    ("bare", 0.15, 0.03),
    ("loops", 0.20, 0.05),
    ("shouts", 0.20, 0.05),
)
STATISTICS = tuple(h[0] for h in HEURISTICS)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def statistics(raw: np.ndarray, offsets: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(a column per statistic, words per text) of a run of texts.

    symbols: share of bytes that prose rarely has; capitals: share of letters;
    sameness: share of words seen before in the text, scaled by its length;
    bare: share of words without a letter; loops: share of words equal to the
    one before; shouts: share of words that end in an exclamation mark.
    """
    bounds = w.bounds()
    n = np.diff(bounds)
    many = np.maximum(n, 1)
    letters = np.maximum(_per_text(_LETTER[raw], offsets), 1)
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = NOT_SPACE[raw]
    last = inside[:-1] & ~inside[1:]
    seams = offsets[1:-1]
    last[seams[seams > 0] - 1] = inside[:-1][seams[seams > 0] - 1]
    first_of = np.flatnonzero(last)
    letters_to = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    starts = np.concatenate([[0], first_of[:-1] + 1]) if len(first_of) else first_of
    bare = (letters_to[first_of + 1] - letters_to[starts]) == 0 if len(first_of) else np.zeros(0, bool)
    order = np.lexsort((w.hash, w.doc))
    repeat = np.zeros(len(order), bool)
    repeat[1:] = (w.hash[order][1:] == w.hash[order][:-1]) & (w.doc[order][1:] == w.doc[order][:-1])
    loops = np.zeros(len(order), bool)
    loops[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    by_word = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])
    sameness = np.where(n >= 20, by_word(repeat) / many, 0) * np.minimum(1, 200 / many) ** 0.1
    columns = [
        _per_text(~_PLAIN[raw], offsets) / np.maximum(np.diff(offsets), 1),
        _per_text(_UPPER[raw], offsets) / letters,
        sameness,
        by_word(bare) / many,
        by_word(loops) / many,
        _per_text(last & (raw == 0x21), offsets) / many,
    ]
    return np.stack(columns, axis=1), n


def _insult_hashes() -> np.ndarray:
    flat = np.frombuffer("".join(INSULTS).encode(), np.uint8)
    ends = np.cumsum([len(x) for x in INSULTS])
    return np.sort(piece_hashes(flat, np.append(0, ends[:-1]), ends))


def votes(stats: np.ndarray, n: np.ndarray, insults: np.ndarray) -> list[str]:
    """A character per labeller, "1", "0" or "-": the heuristics, then the insult list."""
    out = np.full((len(n), len(HEURISTICS) + 1), "-", "<U1")
    for i, (_, bad, good) in enumerate(HEURISTICS):
        out[stats[:, i] >= bad, i] = "0"
        out[stats[:, i] <= good, i] = "1"
    out[n == 0, : len(HEURISTICS)] = "0"
    out[insults >= 1, -1] = "1"
    return ["".join(row) for row in out.tolist()]


#: Numbers that one bin of a statistic has, so that it learns faster than a word.
COPIES = 6


def features(stats: np.ndarray, plain: Words) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each text: its hashed words and stems and binned statistics."""
    index = (np.concatenate([plain.hash, plain.stem]) >> _U(64 - FEATURE_BITS)).astype(np.int64)
    pairs = np.unique(np.concatenate([plain.doc, plain.doc]).astype(np.int64) << FEATURE_BITS | index)
    bounds = np.searchsorted(pairs, np.arange(plain.texts + 1) << FEATURE_BITS)
    bins = np.minimum(15, np.ceil(16 * np.sqrt(np.clip(stats, 0, 1)))).astype(np.uint64)
    salted = bins[:, :, None] + np.arange(1, stats.shape[1] + 1, dtype=np.uint64)[None, :, None] * _U(1 << 20) + np.arange(COPIES, dtype=np.uint64) * _U(1 << 40)
    own = (mix(salted.reshape(len(stats), -1)) >> _U(64 - FEATURE_BITS)).astype(np.int64)
    mask = (1 << FEATURE_BITS) - 1
    return [np.unique(np.concatenate([pairs[a:b] & mask, own[i]])) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]


def _runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, Words]]:
    """(first row, statistics, words per text, insults per text, letter words) of runs of texts."""
    bad = _insult_hashes()
    for (first, raw, offsets), w, plain in zip(text_runs(column), words(column, NOT_SPACE), words(column, _WORD, STEM), strict=True):
        stats, n = statistics(raw, offsets, w)
        found = np.isin(plain.hash, bad)
        yield first, stats, n, np.bincount(plain.doc[found], minlength=plain.texts), plain


def _voted(documents: DataFrame, with_features: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stats, n, insults, plain in _runs(batch.column(1)):
                cols = [batch.column(0).slice(first, plain.texts), pa.array(votes(stats, n, insults), pa.string())]
                if with_features:
                    cols.append(pa.array(features(stats, plain), pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "votes", "features"][: len(cols)])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, votes string" + ", features array<int>" * with_features)


def known_labels(labels: DataFrame) -> DataFrame:
    """_id, q, t: human quality and toxicity of each document, but for the measured fifth."""
    known = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return known.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with two more votes: human quality and toxicity, but for the measured fifth."""
    known = known_labels(labels)
    vote = lambda c: F.coalesce(F.col(c).cast("int").cast("string"), F.lit("-"))
    return rows.join(known, F.col("doc_id") == F.col("_id"), "left").withColumn("votes", F.concat("votes", vote("q"), vote("t"))).drop("_id", "q", "t")


#: Places in a pattern of the labellers of each target; the last of each are people.
QUALITY = (*range(len(HEURISTICS)), len(HEURISTICS) + 1)
TOXIC = (len(HEURISTICS), len(HEURISTICS) + 2)
#: Prior belief in people: this share of all documents as if they had labelled them, TRUST of them rightly.
BELIEF, TRUST = 0.1, 0.98
#: A document that people have labelled counts so many times as evidence of how labellers err.
ANCHOR = 50


@dataclass
class Labellers:
    """What EM has found: prior, outcome[label, labeller, vote] and posteriors by pattern."""

    prior: float
    outcome: np.ndarray
    posterior: dict[str, float]

    def accuracies(self) -> np.ndarray:
        """Of each labeller, the chance that a vote it casts is right."""
        right = (1 - self.prior) * self.outcome[0, :, 0] + self.prior * self.outcome[1, :, 1]
        return right / (right + (1 - self.prior) * self.outcome[0, :, 1] + self.prior * self.outcome[1, :, 0])


def estimate(patterns: dict[str, int], rounds: int = ROUNDS) -> Labellers:
    """EM over counts of vote patterns, a vote being 0, 1 or none ("-"); the last
    labeller of a pattern is a person."""
    names = sorted(patterns)
    x = np.array([["01-".index(c) for c in p] for p in names]).reshape(len(names), -1)
    n = np.array([patterns[p] for p in names], float)
    hot = np.stack([x == v for v in range(3)], axis=2).astype(float)
    ones, zeros = (x == 1).sum(axis=1), (x == 0).sum(axis=1)
    # The start: people, else any vote for the rarer label, decide.  Each kind of
    # fault has one heuristic that sees it, so a majority would outvote it.
    rare = int(n @ ones < n @ zeros)
    p = np.where(ones if rare else zeros, 0.1 + 0.8 * rare, 0.9 - 0.8 * rare)
    p = np.where(x[:, -1] < 2, 0.02 + 0.96 * (x[:, -1] == 1), p)
    belief = np.ones((2, x.shape[1], 3))
    silent = float(n @ hot[:, -1, 2]) / max(n.sum(), 1)  # people's silence says nothing
    for label in range(2):
        says = np.array([TRUST, 1 - TRUST])[:: 1 - 2 * label] * (1 - silent)
        belief[label, -1] += BELIEF * n.sum() * np.append(says, silent)
    weight = n * np.where(x[:, -1] < 2, ANCHOR, 1)
    belief[:, -1] *= weight.sum() / n.sum()
    for _ in range(rounds):
        outcome = np.stack([np.einsum("i,ijv->jv", weight * q, hot) for q in (1 - p, p)]) + belief
        # People's silence is weighed away from their votes: its share is known.
        spoken = outcome[:, -1, :2]
        outcome[:, -1, 2] = spoken.sum(axis=1) * silent / max(1 - silent, 1e-9)
        outcome /= outcome.sum(axis=2, keepdims=True)
        prior = (n @ p + 1) / (n.sum() + 2)
        log = np.log(outcome)
        odds = np.log(prior / (1 - prior)) + np.einsum("ijv,jv->i", hot, log[1] - log[0])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return Labellers(float(prior), outcome, dict(zip(names, p.tolist(), strict=True)))


def train(rows: list[np.ndarray], target: np.ndarray, least: int, epochs: int = EPOCHS, seen: np.ndarray | None = None) -> np.ndarray:
    """Logistic weights of hashed features for soft targets, the bias last.

    Follow-the-regularised-leader steps: the absolute penalty holds features
    that say little, or that few documents have, at zero.  seen: how many
    documents have each feature in a table of which the rows are a sample.
    """
    size = 1 << FEATURE_BITS
    z, n, weights = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    rate = np.where(target >= 0.5, 0.5 / max(target.sum(), 1e-9), 0.5 / max((1 - target).sum(), 1e-9)) * len(target)
    rate = np.minimum(rate, 5)  # classes weigh more alike
    counts = np.bincount(np.concatenate(rows), minlength=size) if rows else np.zeros(size, np.int64)
    common = (counts if seen is None else np.maximum(counts, seen)) >= min(least, len(rows) // 20)
    rows = [np.append(x[common[x]], size) for x in rows]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x = rows[i]
            g = rate[i] * (1 / (1 + np.exp(-np.clip(weights[x].sum(), -30, 30))) - target[i])
            before = np.sqrt(n[x])
            n[x] += g * g
            after = np.sqrt(n[x])
            z[x] += g - (after - before) / STEP * weights[x]
            weights[x] = np.where(np.abs(z[x]) > PENALTY, (np.sign(z[x]) * PENALTY - z[x]) / ((1 + after) / STEP + 1), 0)
    return weights


@dataclass
class Scorer:
    quality: np.ndarray
    toxic: np.ndarray

    def rate(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, stats, n, _, plain in _runs(column):
            rows = features(stats, plain)
            flat, at = np.concatenate(rows), np.cumsum([0] + [len(r) for r in rows])[:-1]
            out = []
            for w in (self.quality, self.toxic):
                z = np.add.reduceat(w[flat], at) + w[-1]
                out.append(np.where(n == 0, 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield out[0], out[1]


def _pick(pattern: str, places: tuple[int, ...]) -> str:
    return "".join(pattern[i] for i in places)


def _counts(patterns: list, places: tuple[int, ...]) -> dict[str, int]:
    out: dict[str, int] = {}
    for r in patterns:
        out[_pick(r["votes"], places)] = out.get(_pick(r["votes"], places), 0) + r["n"]
    return out


def shares(sizes: dict, room: float) -> dict:
    """The share of each class that is drawn so that all get alike, and no more than room together."""
    out = {}
    for i, (name, n) in enumerate(sorted(sizes.items(), key=lambda x: x[1])):
        out[name] = min(1.0, room / (len(sizes) - i) / n)
        room -= out[name] * n
    return out


def draw(documents: DataFrame, labels: DataFrame, total: int, sample: int) -> DataFrame:
    """doc_id, text of about ``sample`` documents, chosen by a hash of doc_id."""
    rows = documents.filter(F.col("doc_id").isNotNull())
    if total <= sample:
        return rows.select("doc_id", "text")
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in documents.columns else F.lit("")
    ids = rows.select("doc_id", lang.alias("_lang")).join(known_labels(labels), F.col("doc_id") == F.col("_id"), "left")
    ids = ids.select("doc_id", "_lang", F.when(F.col("t") >= 1, 1).when(F.col("t") < 1, 0).alias("t"))
    sizes = {(r["t"], r["_lang"]): r["n"] for r in ids.filter("t is not null").groupBy("t", "_lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows per language
    share = {}
    for t in (1, 0):
        share |= shares({k: n for k, n in sizes.items() if k[0] == t}, sample / 3)
    drawn, others = sum(share[k] * n for k, n in sizes.items()), total - sum(sizes.values())
    rest = min(1.0, (sample - drawn) / max(others, 1))
    names = [F.lit(x) for (t, lang_), s in share.items() for x in (f"{t}{lang_}", s)]
    of = F.coalesce(F.try_element_at(F.create_map(*names), F.concat(F.col("t").cast("string"), "_lang")), F.lit(rest)) if names else F.lit(rest)
    ids = ids.filter(F.xxhash64("doc_id").bitwiseAND((1 << 30) - 1) < of * (1 << 30)).select("doc_id").distinct()
    # At most about ``sample`` ids at any input size, so that the texts stay where they are.
    return rows.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")


def seen_by_people(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """How many of the documents whose toxicity people have labelled have each feature."""
    ids = known_labels(labels).filter("t is not null").select(F.col("_id").alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << FEATURE_BITS, np.int64)
        for batch in batches:
            for _, stats, _, _, plain in _runs(batch.column(0)):
                counts += np.bincount(np.concatenate(features(stats, plain)), minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["feature", "n"])

    # The same join at any size: the labels grow with the documents.
    rows = documents.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi").select("text")
    table = rows.mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # at most 2^FEATURE_BITS rows
    out = np.zeros(1 << FEATURE_BITS, np.int64)
    out[table.column("feature").to_numpy()] = table.column("n").to_numpy()
    return out


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Scorer, Labellers, Labellers]:
    """All documents' vote patterns are counted; about ``sample`` documents
    reach the driver as feature numbers."""
    small_batches(documents.sparkSession)
    patterns = with_labels(_voted(documents, False), labels).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ^ labellers
    total = sum(r["n"] for r in patterns)
    quality, toxic = (estimate(_counts(patterns, places)) if patterns else Labellers(0.5, np.zeros((2, 0, 3)), {}) for places in (QUALITY, TOXIC))
    seen = seen_by_people(documents, labels) if total > sample else None
    table = with_labels(_voted(draw(documents, labels, total, sample), True), labels).select("votes", "features").toArrow()
    rows = [np.asarray(x.values) for x in table.column("features")]
    weights = []
    for found, places, least, counts in ((quality, QUALITY, LEAST_DOCUMENTS[0], None), (toxic, TOXIC, LEAST_DOCUMENTS[1], seen)):
        own = [_pick(v, places) for v in table.column("votes").to_pylist()]
        spoken = [i for i, v in enumerate(own) if set(v) != {"-"}]  # the others say nothing of their label
        weights.append(train([rows[i] for i in spoken], np.array([found.posterior[own[i]] for i in spoken]), least, seen=counts))
    return Scorer(*weights), quality, toxic


def rate(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, p_quality, p_toxic, kept of each row."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(scorer)  # 2 x 2^FEATURE_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for q, t in held.value.rate(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(q)), pa.array(q), pa.array(t), pa.array((q >= 0.5) & (t < 0.5))], names=["doc_id", "p_quality", "p_toxic", "kept"])
                at += len(q)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, p_quality double, p_toxic double, kept boolean")


def op2_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return rate(documents, fit(documents, labels)[0])


def measured() -> Column:
    """Whether a document's human labels were kept from training."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
