"""Sizes, durations, type lists, enumerations and display formats as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE_UNITS = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}
DURATION_UNITS = {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}


def _literal(text: Column, pattern: str, units: dict[str, int], fold) -> Column:
    t = fold(F.trim(text))
    unit = F.regexp_extract(t, pattern, 2)
    factor = F.coalesce(*(F.when(unit == u, F.lit(n).cast("long")) for u, n in units.items()))
    number = F.regexp_extract(t, pattern, 1).try_cast("long")
    return F.when(t.rlike(pattern), F.try_multiply(number, factor))


def parse_size(text: Column) -> Column:
    """Bytes of ``10K``, ``5m``, ``100``; null if malformed or too large."""
    return _literal(text, r"^\+?(\d+)([KMGT]?)$", SIZE_UNITS, F.upper)


def parse_duration(text: Column) -> Column:
    """Seconds of ``7d``, ``2h``, ``5m``, ``60s``, ``120``; null if malformed (``5ms`` is)."""
    return _literal(text, r"^\+?(\d+)([smhd]?)$", DURATION_UNITS, F.lower)


#: Type names with aliases (fixed values).
TYPE_NAMES = {"file": "F", "files": "F", "f": "F", "dir": "D", "directory": "D", "directories": "D", "d": "D", "symlink": "L", "link": "L", "l": "L"}


def lookup(table: dict[str, str], name: Column) -> Column:
    """The value of a key, null if there is none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), name)


def parse_types(csv: Column) -> Column:
    """Distinct entry types of a comma list with aliases; null if an item is unknown or empty."""
    codes = F.transform(F.split(csv, ","), lambda x: lookup(TYPE_NAMES, F.lower(F.trim(x))))
    return F.when(~F.exists(codes, lambda c: c.isNull()), F.array_sort(F.array_distinct(codes)))


#: Names and aliases of each enumeration (fixed values).
STRATEGIES = {
    "first": "prefer-first",
    "prefer-first": "prefer-first",
    "last": "prefer-last",
    "prefer-last": "prefer-last",
    "newest": "prefer-newest",
    "prefer-newest": "prefer-newest",
    "oldest": "prefer-oldest",
    "prefer-oldest": "prefer-oldest",
    "largest": "prefer-largest",
    "prefer-largest": "prefer-largest",
    "smallest": "prefer-smallest",
    "prefer-smallest": "prefer-smallest",
    "interactive": "interactive",
    "ask": "interactive",
    "fail": "fail",
    "error": "fail",
    "skip": "skip",
}
METADATA_STRATEGIES = {"strict": "strict", "smart": "smart", "auto": "smart", "relaxed": "relaxed", "loose": "relaxed", "content-only": "content-only", "content": "content-only"}
DELETE_MODES = {"sync": "sync", "no-delete": "no-delete", "nodelete": "no-delete", "delete-after": "delete-after", "deleteafter": "delete-after", "delete-excluded": "delete-excluded", "deleteexcluded": "delete-excluded", "trash": "trash"}
SYMLINK_MODES = {"preserve": "preserve", "keep": "preserve", "follow": "follow", "ignore": "ignore", "skip": "ignore", "relative": "relative"}
RECONCILIATIONS = {"lcd": "lcd", "least-common-denominator": "lcd", "best-effort": "best-effort", "besteffort": "best-effort", "source-wins": "source-wins", "sourcewins": "source-wins", "source": "source-wins"}
RECONCILIATION_OF = {"strict": "lcd", "smart": "best-effort", "relaxed": "best-effort", "content-only": "lcd"}
DESCRIPTIONS = {
    "prefer-first": "Always choose first location",
    "prefer-last": "Always choose last location",
    "prefer-newest": "Choose newest modification time",
    "prefer-oldest": "Choose oldest modification time",
    "prefer-largest": "Choose largest file",
    "prefer-smallest": "Choose smallest file",
    "interactive": "Prompt user interactively",
    "fail": "Fail on any conflict",
    "skip": "Skip conflicted files",
}
STATUS_SYMBOLS = {"unknown": "?", "exists": "+", "missing": "-", "pending": ">", "syncing": "~", "synced": "=", "failed": "!"}


def parse_strategy(text: Column) -> Column:
    """struct(strategy, node_index, node_name); strategy is null if the name is unknown."""
    t = F.lower(text)
    node = F.when(t.startswith("node:"), F.substr(t, F.lit(6)))
    index = F.when(node.rlike(r"^\+?\d+$"), node.try_cast("int"))
    name = F.when(index.isNull(), node)
    strategy = F.when(index.isNotNull(), "node-by-index").when(name.isNotNull(), "node-by-name").otherwise(lookup(STRATEGIES, t))
    return F.struct(strategy.alias("strategy"), index.alias("node_index"), name.alias("node_name"))


def describe_strategy(strategy: Column) -> Column:
    return F.when(strategy == "node-by-index", "Prefer specific node by index").when(strategy == "node-by-name", "Prefer specific node by name").otherwise(lookup(DESCRIPTIONS, strategy))


def megabytes(n: Column) -> Column:
    """Millions of bytes with one digit."""
    return F.format_string("%.1f", n / F.lit(1e6))


def display_path(path: Column, width: int = 45) -> Column:
    return F.when(F.length(path) > width, F.concat(F.left(path, F.lit(width - 3)), F.lit("..."))).otherwise(F.rpad(path, width, " "))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole within 0 and 1; 0 for an empty whole."""
    return F.when(whole > 0, F.least(F.greatest(part / whole, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def age(mtime: Column, now: Column) -> Column:
    """Seconds since, 0 for the future."""
    return F.greatest(now - mtime, F.lit(0))


def is_automatic(strategy: Column) -> Column:
    """Whether a strategy needs no one to ask."""
    return strategy != "interactive"


def allows_deletion(mode: Column) -> Column:
    return mode != "no-delete"
