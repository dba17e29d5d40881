"""Rules as data: the first of any number of glob rules that matches each path.

Each rule is filed under one literal that its matches must have: the beginning, the end, or
letters within.  Of a rule's literals the one that the fewest rules share is taken, the
longer of equals; beginnings and ends are cut to lengths of 1, 2, 4, ..., those within to 3, 4, 6,
8, 12, ... so that a path has few of them, and rules that differ in a long literal
do not share it.  Paths meet rules by equal hashes of literals, candidates are checked by the
regular expression, and the least priority wins.  A rule is chosen its literal by numbers alone
(a hash aggregate): neither patterns nor literals are sorted by the rule.  Rules that match everything hide
those after them; other rules without a literal are filed under the empty one, which every path has.

A null path gives no row, a repeated one a single row; rules with a null pattern or priority
never match; of equal priorities the strategy first in order wins; a malformed pattern fails.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import to_regex
from ..storage import stored

#: Letters of a literal within a pattern: 3 at least.
GRAM = 3
_LENGTHS = [1 << i for i in range(12)]
_WITHIN = [GRAM, *(n for i in range(2, 12) for n in (1 << i, 3 << i - 1))]
_PARTS = "priority long, strategy string, regex string, everything boolean, keys array<struct<kind:string,length:int,text:string>>"


def literals(glob: str) -> list[str]:
    """The pieces of a glob between its wildcards; the first and last ones begin and end every match."""
    out, at, depth = [""], 0, 0
    while at < len(glob):
        c = glob[at]
        if c == "[":
            end = re.compile(r"[!^]?\]?[^\]]*\]").match(glob, at + 1)
            at = end.end() if end else len(glob)
            out.append("")
        elif c == "{" or depth:
            depth += (c == "{") - (c == "}")
            at += 2 if c == "\\" else 1
            out.append("")
        elif c == "*" and re.match(r"\*\*/", glob[at:]) and (at == 0 or glob[at - 1] == "/"):
            out.append("")  # also matches nothing, its slash included
            at += 3
        elif c in "*?":
            out.append("")
            at += 1
        else:
            if c == "\\":
                at += 1
            out[-1] += glob[at]
            at += 1
    return out


def keys(glob: str) -> list[tuple[str, int, str]]:
    """(kind, length, text) of each literal under which a glob may be filed."""
    parts = literals(glob)
    whole = len(parts) == 1
    cut = lambda text, lengths=_LENGTHS: max(n for n in lengths if n <= len(text))
    out = []
    if parts[0]:
        out.append(("begins", cut(parts[0]), parts[0][: cut(parts[0])]))
    if parts[-1]:
        out.append(("ends", cut(parts[-1]), parts[-1][-cut(parts[-1]) :]))
    if not whole:
        for p in parts:
            if len(p) >= GRAM:
                n = cut(p, _WITHIN)
                out += [("holds", n, p[i : i + n]) for i in range(len(p) - n + 1)]
    return out or [("any", 0, "")]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("length", pa.int32()), ("text", pa.string())]))
    for b in batches:
        globs = b.column("pattern").to_pylist()
        found = [[dict(zip(("kind", "length", "text"), k, strict=True)) for k in dict.fromkeys(keys(g))] for g in globs]
        regex = [to_regex(g) for g in globs]
        cols = [b.column("priority"), b.column("strategy"), pa.array(regex, pa.string()), pa.array([r in ("(?s)^.*$", "(?s)^.*.*$") for r in regex], pa.bool_()), pa.array(found, kind)]
        yield pa.RecordBatch.from_arrays(cols, names=["priority", "strategy", "regex", "everything", "keys"])


def _hash(key) -> F.Column:
    return F.xxhash64(key["kind"], key["length"], key["text"])


#: Bits of a literal's number among a rule's own.
_AT = 24


def filed(rules: DataFrame) -> DataFrame:
    """priority, strategy, regex, kind, length, h (hash of the literal): each rule under its rarest literal."""
    rows = rules.filter("pattern IS NOT NULL AND priority IS NOT NULL").select(F.col("priority").cast("long"), F.col("strategy").cast("string"), "pattern")
    rows = rows.groupBy("pattern").agg(F.min(F.struct("priority", "strategy")).alias("r")).select("r.priority", "r.strategy", "pattern")
    read = stored(rows.mapInArrow(_read, _PARTS).withColumn("id", F.monotonically_increasing_id()), "rules-read")
    last = read.filter("everything").agg(F.min("priority")).first()[0]
    rows = read.filter(F.col("priority") <= last) if last is not None else read
    # The longest literals first: of equally rare ones the least number is taken.
    keys_ = F.transform(F.array_sort(F.transform("keys", lambda k: F.struct((-F.length(k["text"])).alias("less"), k.alias("k")))), lambda x: x["k"])
    rows = rows.select("id", "priority", "strategy", "regex", keys_.alias("keys"))
    single = rows.select("id", F.posexplode(F.transform("keys", _hash)).alias("at", "h"))
    counts = single.groupBy("h").agg(F.count("*").alias("n"))
    best = single.join(counts, "h").groupBy("id").agg(F.min(F.shiftleft("n", _AT).bitwiseOR(F.col("at").cast("long"))).alias("best"))
    k = F.get("keys", F.col("best").bitwiseAND((1 << _AT) - 1).cast("int"))
    return rows.join(best, "id").select("priority", "strategy", "regex", k.alias("k")).select("priority", "strategy", "regex", "k.kind", "k.length", _hash(F.col("k")).alias("h"))


def strategies(paths: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """path, strategy of paths (path) by rules (priority, pattern, strategy)."""
    index = stored(filed(rules), "rules")
    classes = [(r.kind, r.length) for r in index.select("kind", "length").distinct().collect()]  # some dozens at most
    path = F.col("path")
    probe = lambda kind, n, text: F.xxhash64(F.lit(kind), F.lit(n), text)
    probes = [F.when(F.length(path) >= n, F.array(probe(kind, n, F.substring(path, 1, n) if kind == "begins" else F.right(path, F.lit(n))))) for kind, n in classes if kind in ("begins", "ends")]
    for n in sorted(n for kind, n in classes if kind == "holds"):
        spots = F.sequence(F.lit(1), F.length(path) - n + 1)
        probes.append(F.when(F.length(path) >= n, F.transform(spots, lambda i: probe("holds", n, path.substr(i, F.lit(n))))))  # noqa: B023
    if any(kind == "any" for kind, _ in classes):
        probes.append(F.array(probe("any", 0, F.lit(""))))
    distinct = paths.select("path").filter("path IS NOT NULL").distinct()
    if not probes:
        return distinct.select("path", F.lit(default).alias("strategy"))
    none = F.array().cast("array<bigint>")
    asked = distinct.select("path", F.explode(F.array_distinct(F.concat(*(F.coalesce(p, none) for p in probes)))).alias("h"))
    met = asked.join(index.select("h", "priority", "strategy", "regex"), "h").filter(F.expr("path rlike regex"))
    first = met.groupBy("path").agg(F.min(F.struct("priority", "strategy")).alias("r")).select("path", F.col("r.strategy").alias("found"))
    return distinct.join(first, "path", "left").select("path", F.coalesce("found", F.lit(default)).alias("strategy"))
