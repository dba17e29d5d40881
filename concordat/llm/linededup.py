"""Near-equal lines across documents, from built-in functions only.

Two different lines are linked if one of two rules holds; ``n`` are the longer
one's characters, ``w`` its words (parts between spaces):

* both have under ``FEW_WORDS`` words and at most min(MOST_EDITS, n / 10) edits of
  characters make one of the other;
* at most w / 10 edits of words (insert, drop, replace) do; empty parts are words.

All such pairs are found; nothing is capped.

Characters: a line is split into MOST_EDITS + 1 segments.  Of two linked lines some
segment of the shorter stands in the longer at a place that the lengths'
difference bounds, so each line is indexed by its segments and probes with the
substrings that may equal a segment of lines up to MOST_EDITS shorter.  A match is
an equi-join on the hash of (length, segment number, substring).  Pairs are then
confirmed by a banded bit-parallel edit distance: a band of 2 * MOST_EDITS + 1
diagonals is kept in the bits of one number, a character of the longer line per step.

Words: w / 10 edits leave w / 10 + 1 segments of which one has at least (w - w / 10)
/ (w / 10 + 1) words.  As the threshold grows with the line, segments at all their
shifts would be too many keys; instead each line keeps the least hash of each
window of word runs, so that lines with so many words in a row in common share one
(``RUNS``).  Pairs that share one must pass bounds on their numbers of words and on the
parities of their bags of words by buckets, and are confirmed by a banded distance over words.

Equal lines are one text from the start, so copies never pair.  The character join
also asks that the texts' counts of eight common characters differ by no more than
so many edits can change; that leaves few pairs of a segment that many edited
copies share.  Keys that one text alone has are left out before anything but numbers is
dealt out.  Classes alone need no pair of every two near copies: texts are tried against
pivots of their keys first (``roots``), and what stays apart meets once a pair, not once
a key (``_met_apart``).  Counts of links take all pairs, but do not make most of them
(``links``): a text's edits are told from a pivot, the most frequent text of its keys.  Two
texts of one pivot are linked if their edits from it are few enough together, and are not if
these differ by too many; the former are counted by how many texts have so many edits
(``_sure``).  What is open of a pivot's texts meets once a pair (``_met_within``), and texts
of different pivots at their keys (``_met_across``).
A key that many texts share is a skewed key of an equi-join of
plain inputs, which adaptive execution splits.

Defined results for odd input: blank lines and null texts have no lines; white
space at a line's ends is ignored; of lines that could open a class the least
(doc_id, line number) does; lines and texts of any length are read whole; repeated
rows repeat their lines' results; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .fingerprint import let
from .shared import discard, few_tasks, materialize

MOST_EDITS = 2
SHARE = 10
SEGMENTS = MOST_EDITS + 1
#: Lines of fewer words are compared by characters.
FEW_WORDS = 20


def _segment(length: Column, i: int) -> tuple[Column, Column]:
    """(start from 0, size) of segment i from 0: sizes differ by one at most, longer ones last."""
    size = F.floor(length / SEGMENTS).cast("int")
    longer = (length % SEGMENTS).cast("int")
    short = SEGMENTS - longer
    start = size * i + F.greatest(F.lit(0), F.lit(i) - short)
    return start, size + (F.lit(i) >= short).cast("int")


def encoded(line: Column) -> Column:
    """Four bytes a character, so that a substring is found without a walk to it."""
    return F.encode(line, "UTF-32")


def _key(code: Column, length: Column, i: int, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(i), F.substr(code, (start * 4 + 1).cast("int"), (size * 4).cast("int")))


def index_keys(code: Column, length: Column) -> list[Column]:
    return [_key(code, length, i, *_segment(length, i)) for i in range(SEGMENTS)]


#: Places of the probes that are a text's own segments.
UNSHIFTED = (0, 2, 4)


def probe_keys(code: Column, length: Column) -> list[Column]:
    """Keys of all substrings that may equal a segment of a line no longer.

    For a line shorter by d, segment i (from 0) is tried at shifts that leave at
    most i edits to its left and MOST_EDITS - i to its right.
    """
    keys = []
    for d in range(MOST_EDITS + 1):
        other = (length - d).cast("int")
        for i in range(SEGMENTS):
            start, size = _segment(other, i)
            rest = MOST_EDITS - i
            keys += [_key(code, other, i, start + s, size) for s in range(max(-i, d - rest), min(i, d + rest) + 1)]
    return keys


#: Characters whose counts, modulo 32, a text's bag holds; in texts without them it rules out nothing.
BAG = " etanisorhld"
_BITS = 5
_MASK = (1 << _BITS) - 1


def bag(line: Column) -> Column:
    out = F.lit(0).cast("long")
    for i, c in enumerate(BAG):
        n = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).cast("long")
        out = out.bitwiseOR(F.shiftleft(n.bitwiseAND(_MASK), _BITS * i))
    return out


def bags_near(a: Column, b: Column, most: Column | int = MOST_EDITS) -> Column:
    """Whether ``most`` edits can make one bag of the other: each changes two counts by one at most."""
    total = F.lit(0).cast("long")
    for i in range(len(BAG)):
        d = F.abs(F.shiftright(a, _BITS * i).bitwiseAND(_MASK) - F.shiftright(b, _BITS * i).bitwiseAND(_MASK))
        total = total + F.least(d, _MASK + 1 - d)
    return total <= 2 * most


def bounded_edits(a: Column, b: Column, most: int = MOST_EDITS) -> Column:
    """The edit distance of a and b, or most + 1 if it is more; length(a) <= length(b).

    Step j takes character j of b; bit k of a vector is row j - most + k of a's
    column.  The score follows the band's lowest diagonal and, from a's last
    row on, that row.
    """
    width = 2 * most + 1
    full = (1 << width) - 1

    def run(x: Column) -> Column:
        p, t = x["p"], x["t"]
        m, n = F.size(p), F.size(t)

        def step(s: Column, j: Column) -> Column:
            matches = F.lit(0)
            c = F.get(t, j)
            for k in range(width):
                i = j + (k - most)
                matches = matches.bitwiseOR(F.when((i >= 0) & (F.get(p, i) == c), 1 << k).otherwise(0))

            def moved(pm: Column) -> Column:
                d0 = (pm.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"]).bitwiseOR(pm).bitwiseOR(s["vn"]).bitwiseAND(full)
                return let(d0, lambda d: _next(s, d, j))

            # Along the last row the score can fall by one a step, no further.
            return F.when(s["score"] > 2 * most + n - m, s).otherwise(let(matches, moved))

        def _next(s: Column, d0: Column, j: Column) -> Column:
            hp = s["vn"].bitwiseOR(F.bitwise_not(d0.bitwiseOR(s["vp"])).bitwiseAND(full))
            hn = d0.bitwiseAND(s["vp"])
            low = F.shiftright(d0, 1)
            # The last row's bit at this step: row m - 1 is bit m - 1 - j + most.
            row = m - 1 - j + most
            bit = F.pow(F.lit(2), F.least(row, F.lit(width - 1))).cast("int")
            along = F.when(hp.bitwiseAND(bit) != 0, 1).when(hn.bitwiseAND(bit) != 0, -1).otherwise(0)
            score = s["score"] + F.when(row >= width - 1, F.when(d0.bitwiseAND(1 << (width - 1)) != 0, 0).otherwise(1)).otherwise(along)
            return F.struct(hn.bitwiseOR(F.bitwise_not(low.bitwiseOR(hp)).bitwiseAND(full)).alias("vp"), low.bitwiseAND(hp).alias("vn"), score.alias("score"))

        # Row -1 + k of column -1: rows from 0 on rise by one each.
        start = F.struct(F.lit(full & ~((1 << most) - 1)).alias("vp"), F.lit(0).alias("vn"), F.least(m, F.lit(most)).alias("score"))
        return F.when(n - m > most, most + 1).otherwise(F.least(F.lit(most + 1), F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["score"])))

    chars = lambda c: F.split(c, "")
    return let(F.struct(chars(a).alias("p"), chars(b).alias("t")), run)


def _blocks_intact(a: Column, b: Column, parts: int = 8) -> Column:
    """True unless more than MOST_EDITS of a's parts are found nowhere near in b;
    a cheap necessary condition of a link."""
    n = F.char_length(a)
    size = F.floor(n / parts).cast("int")
    lost = F.lit(0)
    for i in range(parts):
        part = F.substr(a, size * i + 1, size)
        around = F.substr(b, F.greatest(F.lit(1), size * i + 1 - MOST_EDITS), size + 2 * MOST_EDITS)
        lost = lost + (~F.contains(around, part)).cast("int")
    return lost <= MOST_EDITS


#: (words of a run, runs of a window, least and most words of a line): lines that can
#: be linked share a row, and there have size + window - 1 words in a row in common.
RUNS = ((3, 3, 9, 19), (3, 4, 18, 39), (4, 5, 36, None))


def word_hashes(line: Column) -> Column:
    return F.transform(F.split(line, " "), lambda w: F.xxhash64(w))


#: Longs of buckets over which the parities of words are kept.
WIDE = 8
COUNTS = tuple(f"odd{j}" for j in range(WIDE))
#: Repeats of a word that are told apart; further ones fall on one bucket.
REPEATS = 8


#: Windows of runs, or words, that one row makes.
BLOCK = 4


def word_parities(texts: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` and COUNTS of the texts: the exclusive ors of their words' bits; one row each that differs in ``kept``.

    A word's bit is that of its hash and of how many equal ones stand before it, so two texts' longs differ in as
    many bits as their bags of words do, at most.
    """
    # Equal words are neighbours.
    hashes = F.when(F.col("w") >= SHARE - 1, F.sort_array(word_hashes(F.col("line")))).otherwise(F.array().cast("array<bigint>"))
    rows = texts.select(*kept, hashes.alias("s"))
    rows = rows.select(*kept, "s", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("s") - 1), F.lit(BLOCK))).alias("i"))
    near = REPEATS - 1
    rows = rows.select(*kept, *(F.get("s", F.col("i") + (j - near)).alias(f"g{j}") for j in range(BLOCK + near)))
    before = [" + ".join(f"cast(g{j + k} <=> g{j + near} as int)" for k in range(near)) for j in range(BLOCK)]
    rows = rows.select(*kept, *(F.expr(f"if(g{j + near} is null, null, xxhash64(g{j + near}, {before[j]}))").alias(f"h{j}") for j in range(BLOCK)))
    # No word is no bit.
    rows = rows.select(*kept, *(F.expr(f"coalesce(shiftleft(1L, cast(h{j} & 63 as int)), 0L)").alias(f"b{j}") for j in range(BLOCK)), *(F.expr(f"cast((h{j} >> 6) & {WIDE - 1} as int)").alias(f"c{j}") for j in range(BLOCK)))
    odd = [F.expr("bit_xor(" + " ^ ".join(f"if(c{k} = {j}, b{k}, 0L)" for k in range(BLOCK)) + f") as {c}") for j, c in enumerate(COUNTS)]
    return rows.groupBy(*kept).agg(*odd)


def run_keys(texts: DataFrame, size: int, window: int, fewest: int, most: int | None) -> DataFrame:
    """t, key: the least hashes of the windows of runs of texts of ``fewest`` to ``most`` words, repeats in a row once.

    A row per BLOCK windows is made and left in one fused stage; functions of arrays would be interpreted word by word.
    """
    rows = texts.filter((F.col("w") >= fewest) & (F.col("w") <= most) if most else F.col("w") >= fewest)
    rows = rows.select("t", (F.col("w") - (size + window - 1)).cast("int").alias("last"), F.split("line", " ").alias("s"))
    rows = rows.select("t", "last", "s", F.explode(F.sequence(F.lit(0), "last", F.lit(BLOCK))).alias("i"))
    # Of the last window before these on: words, runs of words, windows of runs.
    words = [F.xxhash64(F.get("s", F.col("i") + (j - 1))).alias(f"g{j}") for j in range(BLOCK + window + size - 1)]
    runs = [F.xxhash64(*(f"g{j + k}" for k in range(size))).alias(f"r{j}") for j in range(BLOCK + window)]
    least = [F.least(*(f"r{j + k}" for k in range(window))).alias(f"m{j}") for j in range(BLOCK + 1)]
    rows = rows.select("t", "last", "i", *words).select("t", "last", "i", *runs).select("t", "last", "i", *least)
    fresh = [F.expr(f"if(i + {j} <= last and (i + {j} = 0 or m{j + 1} <> m{j}), m{j + 1}, null)") for j in range(BLOCK)]
    return rows.select("t", F.explode(F.array(*fresh)).alias("key")).filter("key is not null")


def keyed(texts: DataFrame) -> DataFrame:
    """key, v: a row per text and key that a linked text may share; v is 2 * t, and 1 more if one of the two has to be such a row."""
    n, code, w = F.col("n"), F.col("code"), F.col("w")
    own = lambda k: F.shiftleft("t", 1).bitwiseOR(k)
    few = texts.filter(w < FEW_WORDS).select("t", "n", encoded(F.col("line")).alias("code"))
    # A text's unshifted probes are its own segments.
    probes = [F.when(n >= SHARE, k) for i, k in enumerate(probe_keys(code, n)) if i not in UNSHIFTED]
    few = few.select("t", F.posexplode(F.array(*index_keys(code, n), *probes)).alias("at", "key")).filter("key is not null")
    few = few.select("key", own((F.col("at") < SEGMENTS).cast("long")).alias("v"))
    for r in RUNS:
        few = few.union(run_keys(texts, *r).select("key", own(F.lit(1)).alias("v")))
    return few


#: The JVM compiles no method over 8000 bytes; larger ones run outside the fused stage, in parts.
LIMIT = "spark.sql.codegen.hugeMethodLimit"
#: Shared parts of a condition would be computed for every pair, also where an earlier bound decides.
METHODS = {LIMIT: "8000", "spark.sql.subexpressionElimination.enabled": "false"}


def shared_keys(texts: DataFrame) -> DataFrame:
    """key, t, own, first (the key's least text): the rows of keys that several texts have; materialised.

    Numbers alone are dealt out, once, and most keys, which one text has, end there.
    """
    rows = keyed(texts).repartition("key")
    of = lambda v: F.shiftright(v, 1)
    several = rows.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(F.col("v").bitwiseAND(1)).alias("some")).filter((of("lo") < of("hi")) & (F.col("some") == 1))
    rows = rows.join(several.select("key", of("lo").alias("first")).hint("shuffle_hash"), "key")
    rows = rows.select("key", of("v").alias("t"), (F.col("v").bitwiseAND(1) == 1).alias("own"), "first")
    return materialize(rows, "lines-keys", {LIMIT: METHODS[LIMIT]})


#: What bounds a link without the lines.
BOUNDS = ("n", "w", "bag", "parity")


def _most(reach: int = 1) -> str:
    """``reach`` times the edits of words that texts a and b may be apart."""
    return f"({reach} * (greatest(w_a, w_b) div {SHARE}))"


def _possible() -> Column:
    """Whether texts a and b can be linked, by their numbers of characters and words, bags and parities."""
    few = F.expr(f"w_a < {FEW_WORDS} and w_b < {FEW_WORDS} and abs(n_a - n_b) <= {MOST_EDITS}") & bags_near(F.col("bag_a"), F.col("bag_b"))
    return few | F.expr(f"abs(w_a - w_b) <= {_most()} and bit_count(parity_a ^ parity_b) + abs(w_a - w_b) <= 2 * {_most()}")


def _counts_near(reach: int = 1) -> Column:
    """Whether a's and b's words by buckets allow a link, or ``reach`` times its edits of words.

    An edit changes two bits at most; to drop or insert a word, of which the difference in words asks for some, one.
    """
    apart = " + ".join(f"bit_count({c}_a ^ {c}_b)" for c in COUNTS)
    return F.expr(f"(w_a < {FEW_WORDS} and w_b < {FEW_WORDS}) or {apart} + abs(w_a - w_b) <= 2 * {_most(reach)}")


def sieve(rows: int) -> dict[str, str]:
    """Settings for a join with ``rows`` wanted numbers: a Bloom filter of them, of at most 8 MB, sifts the other side before its shuffle."""
    own = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1t", "expectedNumItems": str(max(1, min(rows, 4_000_000))), "numBits": str(min(max(10 * rows, 1 << 16), 1 << 26))}
    return {f"spark.sql.optimizer.runtime.bloomFilter.{k}": v for k, v in own.items()}


def _only(texts: DataFrame, wanted: DataFrame, name: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What is made of the texts whose t is in wanted; materialised.  Of the lines few others are dealt out."""
    wanted = materialize(few_tasks(wanted.select("t").distinct(), wanted.count()), "lines-numbers")
    # No t is negative; Spark builds the Bloom filter only from rows that a condition selects.
    out = materialize(made(texts.join(wanted.filter("t >= 0"), "t", "left_semi")), name, sieve(wanted.count()))
    discard(wanted)
    return out


def _counted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """t, BOUNDS and COUNTS of the texts whose t is in wanted; materialised."""

    def made(own: DataFrame) -> DataFrame:
        few = F.when(F.col("w") < FEW_WORDS, bag(F.col("line"))).otherwise(F.lit(0).cast("long"))
        kept = ["t", "n", "w", "bag"]
        return word_parities(own.withColumn("bag", few), kept).select(*kept, F.expr(" ^ ".join(COUNTS)).alias("parity"), *COUNTS)

    return _only(texts, wanted, "lines-counted", made)


def _named(rows: DataFrame, s: str, *columns: str) -> DataFrame:
    return rows.select(F.col("t").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns))


def _bounded(pairs: DataFrame, few: DataFrame, bound: Column) -> DataFrame:
    """The pairs (a, b) that can be linked, by what few (of _counted) tells of them; materialised."""
    columns = ("t", *BOUNDS, *COUNTS)
    out = pairs.join(_named(few, "a", *columns[1:]), "a").join(_named(few, "b", *columns[1:]), "b")
    return materialize(out.filter(bound).select("a", "b"), "lines-pairs", METHODS)


#: Texts are told to be near a pivot up to so many times the edits of a link.
REACH = 2


def _pivoted(rows: DataFrame, few: DataFrame, texts: DataFrame) -> DataFrame:
    """t, pivot, d (edits of words), near (whether these are a link's): texts of FEW_WORDS words or more within REACH times a link's edits of their pivot, and pivots themselves; materialised.

    A text is tried against the one text that is the first of most of its keys.
    """
    firsts = rows.filter("t <> first").select("t", "first").repartition("t").groupBy("t", "first").agg(F.count(F.lit(1)).alias("keys"))
    tried = firsts.groupBy("t").agg(F.max_by("first", "keys").alias("a")).select("a", F.col("t").alias("b"))
    pairs = _bounded(tried, few, F.expr(f"w_a >= {FEW_WORDS} and w_b >= {FEW_WORDS}") & _counts_near(REACH))
    found = _apart(pairs, texts, REACH)
    pivots = found.select("a").distinct()
    own = found.join(pivots.select(F.col("a").alias("b")), "b", "left_anti").select(F.col("b").alias("t"), F.col("a").alias("pivot"), "d", F.expr("d <= most").alias("near"))
    out = materialize(own.union(pivots.select("a", "a", F.lit(0), F.lit(True))), "lines-pivoted")
    discard(pairs, found)
    return out


def _sure(members: DataFrame) -> DataFrame:
    """t, sure: how many texts of its pivot are surely linked with a text, as their edits from the pivot together are few enough.

    Texts of as many edits and words by tens are counted together, so no pair is made.
    """
    cells = members.groupBy("pivot", "d", F.expr(f"w div {SHARE}").alias("most")).agg(F.count(F.lit(1)).alias("texts"))
    x, y = (cells.select("pivot", *(F.col(c).alias(f"{c}_{s}") for c in ("d", "most", "texts"))) for s in "ab")
    sure = x.join(y, "pivot").filter("d_a + d_b <= greatest(most_a, most_b)").groupBy("pivot", "d_a", "most_a").agg(F.sum("texts_b").alias("sure"))
    at = (F.col("pivot"), F.col("d_a").alias("d"), F.col("most_a").alias("most"))
    # A cell that is sure of itself counts the text as well.
    sure = sure.select(*at, (F.col("sure") - F.expr("2 * d_a <= most_a").cast("int")).alias("sure"))
    return members.select("t", "pivot", "d", F.expr(f"w div {SHARE}").alias("most")).join(sure, ["pivot", "d", "most"]).select("t", "sure")


def _met_within(members: DataFrame) -> DataFrame:
    """a, b, a < b: the texts of one pivot that can be linked, but are not surely; materialised."""
    more = ("pivot", "d", *BOUNDS, *COUNTS)
    x, y = _named(members, "a", *more), _named(members, "b", *more)
    on = (F.col("pivot_a") == F.col("pivot_b")) & F.expr(f"a < b and d_a + d_b > {_most()} and abs(d_a - d_b) <= {_most()}") & _possible() & _counts_near()
    return materialize(x.join(y, on).select("a", "b"), "lines-pairs", METHODS)


def _met_across(rows: DataFrame, few: DataFrame, members: DataFrame) -> DataFrame:
    """a, b, a < b: the texts of different pivots that share a key and can be linked; materialised.

    Of a key's texts those of its first one's pivot never meet each other.
    """
    more = ("key", "own", "pivot", "minor", *BOUNDS)
    rows = rows.join(few.select("t", *BOUNDS), "t").join(members.select("t", "pivot"), "t", "left")
    rows = rows.select("t", "key", "own", F.coalesce("pivot", "t").alias("pivot"), *BOUNDS).repartition("key")
    mixed = rows.groupBy("key").agg(F.min_by("pivot", "t").alias("main"), F.min("pivot").alias("lo"), F.max("pivot").alias("hi")).filter("lo <> hi")
    met = rows.join(mixed.select("key", "main").hint("shuffle_hash"), "key").withColumn("minor", F.col("pivot") != F.col("main"))
    met = materialize(met.select("t", *more), "lines-met")  # a plain input: its skew can be split
    x, y = _named(met.filter("minor"), "a", *more), _named(met, "b", *more)
    on = (F.col("key_a") == F.col("key_b")) & F.expr("pivot_a <> pivot_b and (not minor_b or a < b) and (own_a or own_b)") & _possible()
    out = x.join(y, on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(out, "lines-pairs", METHODS)
    discard(met)
    out = _bounded(pairs, few, _counts_near())
    discard(pairs)
    return out


#: The most frequent keys of a text that tell where two texts meet, and how many texts such a key has at least.
TOPS, OFTEN = 8, 16


def _met_apart(rows: DataFrame, few: DataFrame) -> DataFrame:
    """a, b, a < b: the texts of different roots that share a key and can be linked; materialised.

    Two texts meet at every key they share; if some of those are among the most frequent of
    both, at the first of these only.
    """
    often = rows.groupBy("key").agg((-F.count(F.lit(1))).alias("less")).filter(F.col("less") <= -OFTEN)
    tops = rows.filter("own").join(often, "key").groupBy("t").agg(F.slice(F.array_sort(F.collect_set(F.struct("less", "key"))), 1, TOPS).alias("tops"))
    tops = materialize(tops.select("t", F.col("tops.key").alias("tops")), "lines-tops")
    more = ("key", "own", "root", "tops", *BOUNDS, *COUNTS)
    met = rows.join(few, "t").join(tops, "t", "left").withColumn("tops", F.coalesce("tops", F.array().cast("array<bigint>")))
    met = materialize(met.select("t", *more), "lines-met")  # a plain input: its skew can be split
    x, y = _named(met, "a", *more), _named(met, "b", *more)
    first = F.coalesce(F.get(F.array_intersect("tops_a", "tops_b"), F.lit(0)), F.col("key_a")) == F.col("key_a")
    on = (F.col("key_a") == F.col("key_b")) & F.expr("a < b and (own_a or own_b) and root_a <> root_b") & _possible() & _counts_near() & first
    out = materialize(x.join(y, on).select("a", "b").distinct(), "lines-pairs", METHODS)
    discard(tops, met)
    return out


def _coded(codes: Column) -> Column:
    """A string of a character per number below 2^20, all beyond the first plane."""
    return F.decode(F.unhex(F.array_join(F.transform(codes, lambda c: F.lpad(F.hex(c + 0x10000), 8, "0")), "")), "UTF-32")


def hashed_words(line: Column) -> Column:
    return F.transform(F.split(line, " "), lambda w: F.xxhash64(w).bitwiseAND((1 << 20) - 1))


def _levenshtein(x: Column, y: Column, most: Column) -> Column:
    """The distance of x and y, or null if it is more than ``most``."""
    return F.get(F.filter(F.array(F.call_function("levenshtein", x, y, most)), lambda d: d >= 0), F.lit(0))


#: So many edits are tried first, in narrow bands: most pairs are few edits apart, and lines can be long.
BANDS = (4, 16, 64, 256)


def words_apart(x: Column, y: Column, coded_x: Column, coded_y: Column, most: Column) -> Column:
    """The edits of words between lines x and y, or null if they are more than ``most``.

    The codes of hashed words decide if they can only make the distance less; where two
    words of the pair have one code, the words' places among the pair's decide.
    """

    def exactly(pair: Column) -> Column:
        places = lambda words: F.transform(words, lambda w: F.array_position(pair["all"], w))
        one_code = F.size(F.array_distinct(F.split(F.concat(coded_x, coded_y), ""))) < F.size(pair["all"])
        return F.when(pair["d"].isNotNull() & one_code, _levenshtein(_coded(places(pair["x"])), _coded(places(pair["y"])), most)).otherwise(pair["d"])

    wider = [F.when(most > tried, _levenshtein(coded_x, coded_y, F.least(F.lit(band), most) if band else most)) for tried, band in zip(BANDS, (*BANDS[1:], None))]
    distance = F.coalesce(_levenshtein(coded_x, coded_y, F.least(F.lit(BANDS[0]), most)), *wider)
    parts = lambda c: F.split(c, " ")
    return let(F.struct(distance.alias("d"), parts(x).alias("x"), parts(y).alias("y"), F.array_union(parts(x), parts(y)).alias("all")), exactly)


def words_within(x: Column, y: Column, coded_x: Column, coded_y: Column, most: Column) -> Column:
    """Whether lines x and y are within ``most`` edits of words."""
    return words_apart(x, y, coded_x, coded_y, most).isNotNull()


#: ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(documents: DataFrame) -> DataFrame:
    """doc_id, doc_hash, line_no (from 0), line, h, g, n: the lines that are not
    blank, with two hashes and their characters."""
    # Spaces are trimmed fast; only a text with other white space needs the general way.
    odd = F.lit(False)
    for c in BLANKS:
        if c not in " \n":
            odd = odd | F.contains("text", F.lit(c))
    # Beside a generator, these would be computed once a line.
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("doc_hash"), odd.alias("odd"))
    rows = rows.select("doc_id", "doc_hash", "odd", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    rows = rows.select("doc_id", "doc_hash", "line_no", F.when(F.col("odd"), F.btrim("raw", F.lit(BLANKS))).otherwise(F.trim("raw")).alias("line")).filter("line <> ''")
    return rows.select("*", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), F.char_length("line").alias("n"))


#: The lowest bit of a text's number that tells how often it occurs, and the most doublings told.
_OFTEN_BIT, _DOUBLED = 58, 15


def texts_of(lines: DataFrame) -> DataFrame:
    """t, h, g, line, n, w (words): the different texts long enough to be linked; materialised.

    Of two texts of which one occurs more than twice as often, it has the lower t: near copies have it in common.
    """
    texts = lines.filter(F.col("n") >= SHARE - MOST_EDITS).groupBy("line").agg(F.count(F.lit(1)).alias("copies"))
    words = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    rare = F.lit(_DOUBLED) - F.least(F.lit(_DOUBLED), F.floor(F.log2("copies")).cast("int"))
    t = F.shiftleft(rare.cast("long"), _OFTEN_BIT).bitwiseOR(F.monotonically_increasing_id())
    texts = texts.select(t.alias("t"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), "line", F.char_length("line").alias("n"), words.alias("w"))
    return materialize(texts, "lines-texts")


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked; materialised, as _apart has them."""
    return _apart(pairs, texts, 1)


def _apart(pairs: DataFrame, texts: DataFrame, reach: int) -> DataFrame:
    """a, b, d: the pairs (a, b) that are linked, or within ``reach`` times a link's edits of words, those edits (null: linked by characters) and most, a link's edits of words; materialised."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("t"))
    code = F.when(F.col("w") >= SHARE - 1, _coded(hashed_words(F.col("line")))).alias("code")
    found = _only(texts, wanted, "lines-wanted", lambda own: own.select("t", "line", "n", "w", code))
    both = pairs.join(_named(found, "a", *found.columns[1:]), "a").join(_named(found, "b", *found.columns[1:]), "b")
    shorter = F.col("n_a") <= F.col("n_b")
    x, y = (F.when(c, F.col("line_a")).otherwise(F.col("line_b")) for c in (shorter, ~shorter))
    both = both.select("a", "b", x.alias("x"), y.alias("y"), "code_a", "code_b", F.greatest("n_a", "n_b").alias("n"), F.abs(F.col("n_a") - F.col("n_b")).alias("longer"), F.greatest("w_a", "w_b").alias("w"))
    chars = F.least(F.lit(MOST_EDITS), F.floor(F.col("n") / SHARE).cast("int"))
    few = (F.col("w") < FEW_WORDS) & (F.col("longer") <= chars) & _blocks_intact(F.col("x"), F.col("y")) & (bounded_edits(F.col("x"), F.col("y")) <= chars)
    words = reach * F.floor(F.col("w") / SHARE).cast("int")
    many = F.when(words > 0, words_apart(F.col("x"), F.col("y"), F.col("code_a"), F.col("code_b"), words))
    # A row of a generator, as a filter would have the distance computed once more.
    both = both.select("a", "b", "w", F.explode(F.array_compact(F.array(F.coalesce(many, F.when(few, F.lit(-1)))))).alias("d"))
    out = materialize(both.select("a", "b", F.expr("nullif(d, -1)").alias("d"), F.expr(f"w div {SHARE}").alias("most")), "lines-links")
    discard(found)
    return out


def links(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b (a < b): links of texts (of texts_of) that connect what all links connect; node, n_links: how many
    links each text has, if any); both materialised.

    Texts of one pivot are surely linked if their edits from it are few enough together; that is counted,
    not made.  All other pairs that can be linked are tried.
    """
    rows = shared_keys(texts)
    few = _counted(texts, rows)
    pivoted = _pivoted(rows, few, texts)
    members = materialize(pivoted.join(few, "t"), "lines-members")
    met = [_met_within(members), _met_across(rows, few, members)]
    found = _confirm(met[0].union(met[1]), texts)
    n_links = found.select(F.explode(F.array("a", "b")).alias("t"), F.lit(1).cast("long").alias("n")).union(_sure(members).select("t", F.col("sure").alias("n")))
    n_links = materialize(n_links.groupBy(F.col("t").alias("node")).agg(F.sum("n").alias("n_links")), "lines-degrees")
    stars = pivoted.filter("near and t <> pivot").select(F.col("pivot").alias("a"), F.col("t").alias("b"))
    edges = materialize(found.select("a", "b").union(stars), "lines-edges")
    discard(rows, few, pivoted, members, *met, found)
    return edges, n_links


def roots(texts: DataFrame) -> DataFrame:
    """node, root of every text with a link, from links that connect what all links connect; materialised.

    The texts of a key are tried against one of them, first the least, then one that
    differs from key to key, so n near copies take a few times n pairs.  Of the keys that
    still hold several components, all pairs of different ones are tried.
    """
    rows = shared_keys(texts)
    few = _counted(texts, rows)
    out, open_ = None, rows.withColumn("root", F.col("t"))
    for turn in range(3):
        if turn < 2:
            if turn:
                # The least t of an order that a key has for itself: t is had back from t ^ key.
                least = F.min(F.struct(F.col("t").bitwiseXOR(F.col("key")).alias("t"), "root")).alias("least")
                tried = open_.join(open_.groupBy("key").agg(least), "key").filter("root <> least.root").withColumn("pivot", F.col("least.t").bitwiseXOR(F.col("key")))
            else:
                tried = open_.filter("t <> first").withColumn("pivot", F.col("first"))
            tried = tried.select(F.least("t", "pivot").alias("a"), F.greatest("t", "pivot").alias("b")).distinct()
            pairs = _bounded(tried, few, _possible() & _counts_near())
        else:
            pairs = _met_apart(open_, few)
        found = _confirm(pairs, texts)
        discard(pairs)
        joined = not found.isEmpty()
        if joined or out is None:
            edges = found.select("a", "b")
            was, out = out, components(edges if out is None else edges.union(out.select(F.col("node").alias("a"), F.col("root").alias("b"))), "lines-components")
            if was is not None:
                discard(was)
        discard(found)
        if turn < 2 and (joined or not turn):
            now = open_.drop("root").join(out.withColumnRenamed("node", "t"), "t", "left").withColumn("root", F.coalesce("root", "t"))
            now = materialize(now, "lines-open")  # a plain input: its skew can be split
            discard(rows)
            mixed = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
            rows = open_ = materialize(now.join(mixed, "key", "left_semi"), "lines-open")
            discard(now)
            if open_.isEmpty():
                break
    discard(rows, few)
    return out


def line_classes(documents: DataFrame, counted: bool = True) -> DataFrame:
    """A row per line: doc_id, doc_hash, line_no, n_chars, class_doc_id, class_line_no,
    n_links (other texts linked with its text; if ``counted``), kept (it opens its class).
    ``passed`` of the result has the tables that it is read from."""
    texts = texts_of(lines_of(documents))
    if counted:
        edges, n_links = links(texts)
        passed = [edges, n_links, components(edges, "lines-components")]
        linked = passed[2].join(n_links, "node")
    else:
        passed = [roots(texts)]
        linked = passed[0].withColumn("n_links", F.lit(None).cast("long"))
    linked = materialize(linked.join(texts.select(F.col("t").alias("node"), "h", "g"), "node").select("h", "g", "root", "n_links"), "lines-linked")
    discard(texts, *passed)
    lines = lines_of(documents).select("doc_id", "doc_hash", "line_no", "h", "g", F.col("n").cast("long").alias("n_chars"))
    lines = materialize(lines, "lines-hashes")
    texts = lines.groupBy("h", "g").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"))
    texts = texts.join(linked, ["h", "g"], "left").filter("n > 1 or root is not null")
    texts = materialize(texts, "lines-repeated")
    opens = materialize(texts.filter("root is not null").groupBy("root").agg(F.min("first").alias("opens")), "lines-opens")
    repeated, texts = texts, texts.join(opens, "root", "left").select("h", "g", F.coalesce("opens", "first").alias("opens"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    texts = materialize(texts, "lines-classes")  # plain inputs: the join's skew can be split
    discard(linked, repeated, opens)
    own = F.struct("doc_id", "line_no")
    out = lines.join(texts, ["h", "g"], "left").withColumn("opens", F.coalesce("opens", own))
    n_links = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] * counted
    out = out.select(
        "doc_id", "doc_hash", F.col("line_no").cast("long").alias("line_no"), "n_chars",
        F.col("opens.doc_id").alias("class_doc_id"), F.col("opens.line_no").cast("long").alias("class_line_no"),
        *n_links, own.eqNullSafe(F.col("opens")).alias("kept"),
    )
    out.passed = lines, texts
    return out


def op7_segment_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("doc_hash")


#: Lines of fewer characters stay: short lines repeat by chance; 0 lets all go.
SHORTEST_DROPPED = 25


def drop_repeated_lines(documents: DataFrame, shortest: int = SHORTEST_DROPPED) -> DataFrame:
    """documents without the lines of at least ``shortest`` characters whose class
    an earlier line opens; documents that lose all their lines go, and n_chars,
    if there is one, follows.  The work is linear in a text's lines."""
    classes = line_classes(documents, counted=False)
    gone = classes.filter(~F.col("kept") & (F.col("n_chars") >= shortest))
    gone = materialize(gone.groupBy("doc_id", "doc_hash").agg(F.collect_set("line_no").alias("gone")), "lines-gone")
    discard(*classes.passed)
    gone = gone.select(F.struct("doc_id").alias("id"), "doc_hash", "gone")
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("d"))
    out = rows.join(gone, F.struct("d.doc_id").eqNullSafe(F.col("id")) & F.xxhash64("d.text").eqNullSafe(F.col("doc_hash")), "left")
    lines = F.split("d.text", "\n")
    left = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(lines).cast("long") - 1), "gone")
    left = let(lines, lambda all_: F.array_join(F.transform(left, lambda i: F.get(all_, i.cast("int"))), "\n"))
    out = out.select("d", F.col("gone").isNull().alias("whole"), F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(left).alias("text"))
    out = out.filter(F.col("whole") | (F.trim("text") != ""))
    own = {c: F.col(f"d.`{c}`") for c in documents.columns} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("whole"), own["n_chars"]).otherwise(F.char_length("text").cast(documents.schema["n_chars"].dataType))
    return out.select(*(v.alias(c) for c, v in own.items()))
