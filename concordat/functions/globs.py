"""Globs as regular expressions (translated on the driver, matched in the JVM).

Dialect: ``?`` one character, ``*`` any run, ``**/`` any directories, ``/**``
everything below, ``[...]`` classes with ``!`` or ``^`` negation, ``{a,b}``
alternatives, ``\\`` escapes.  ``*`` and ``?`` cross ``/`` unless
``literal_separator`` is set.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Always excluded: the package's own state and staged files, then fixed values.
ALWAYS_EXCLUDED = (
    ".concordat/**",
    "**/*.concordat-tmp",
    ".Trash-*/**",
    "lost+found/**",
    "**/.DS_Store",
    "**/Thumbs.db",
    "**/desktop.ini",
    "**/*.swp",
    "**/*.swo",
    "**/*~",
    "**/.nfs*",
)


class InvalidPattern(ValueError):
    pass


def _class(glob: str, at: int, separator: bool) -> tuple[str, int]:
    end = at + 1
    negated = glob[end : end + 1] in ("!", "^")
    end += negated
    items = ""
    first = True
    while end < len(glob) and (glob[end] != "]" or first):
        first = False
        items += "\\" + glob[end] if glob[end] in "\\[]^&~" else glob[end]
        end += 1
    if end >= len(glob):
        raise InvalidPattern(f"{glob}: unclosed class")
    for low, high in re.findall(r"(\w)-(\w)", items):
        if low > high:
            raise InvalidPattern(f"{glob}: range {low}-{high}")
    body = f"[{'^' if negated else ''}{items}]"
    return (f"(?!/){body}" if separator and negated else body), end + 1


def to_regex(glob: str, literal_separator: bool = False) -> str:
    """The anchored regular expression of a glob; InvalidPattern if it is malformed."""
    any_, run = ("[^/]", "[^/]*") if literal_separator else (".", ".*")
    out, at, depth = "", 0, 0
    while at < len(glob):
        c = glob[at]
        if c == "*":
            stars = re.match(r"\*+", glob[at:])[0]
            after = glob[at + len(stars) : at + len(stars) + 1]
            opens = at == 0 or glob[at - 1] == "/"
            if len(stars) == 2 and opens and after == "/":
                out += "(?:.*/)?"
                at += 3
                continue
            out += ".*" if len(stars) == 2 and opens and after == "" else run
            at += len(stars)
        elif c == "?":
            out, at = out + any_, at + 1
        elif c == "[":
            text, at = _class(glob, at, literal_separator)
            out += text
        elif c == "{":
            out, at, depth = out + "(?:", at + 1, depth + 1
        elif c == "}" and depth:
            out, at, depth = out + ")", at + 1, depth - 1
        elif c == "," and depth:
            out, at = out + "|", at + 1
        elif c == "\\":
            if at + 1 == len(glob):
                raise InvalidPattern(f"{glob}: dangling escape")
            out, at = out + re.escape(glob[at + 1]), at + 2
        else:
            out, at = out + re.escape(c), at + 1
    if depth or (glob.count("}") > glob.count("{") and "[" not in glob):
        raise InvalidPattern(f"{glob}: unbalanced braces")
    return f"(?s)^{out}$"


def any_of(column: Column, globs, literal_separator: bool = False) -> Column:
    """Whether a path matches any glob: one alternation, compiled once a task.

    Patterns that are a literal prefix and ``/**`` become startswith, which
    Parquet scans can use to skip row groups.
    """
    prefixes, rest = [], []
    for g in globs:
        to_regex(g, literal_separator)
        if re.fullmatch(r"[^*?\[\]{}\\]+/\*\*", g):
            prefixes.append(g[:-2])
        else:
            rest.append(to_regex(g, literal_separator)[4:])
    out = F.lit(False)
    for p in prefixes:
        out = out | (column.startswith(p) & (F.length(column) > len(p)))
    if rest:
        out = out | column.rlike("(?s)" + "|".join(rest))
    return out
