"""Exclusion: globs, ignore files and property filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.globs import ALWAYS_EXCLUDED, any_of, to_regex
from ..storage import names, read_text

IGNORE_FILES = (".syncignore", ".gitignore", ".dockerignore", ".npmignore", ".rgignore")


def is_excluded(path: Column, exclude: Sequence[str] = (), include: Sequence[str] = (), always: Sequence[str] = ALWAYS_EXCLUDED) -> Column:
    """Always-excluded before included before excluded."""
    return any_of(path, always) | (~any_of(path, include, literal_separator=True) & any_of(path, exclude))


def excluded_counts(inventory: DataFrame, **patterns) -> DataFrame:
    return inventory.groupBy("node_idx").agg(F.count_if(is_excluded(F.col("path"), **patterns)).alias("n_excluded"), F.count(F.lit(1)).alias("n_total"))


@dataclass(frozen=True)
class PropertyFilter:
    """Size and age ranges, both ends inside, and allowed types; bounds may be open."""

    min_size: int | None = None
    max_size: int | None = None
    min_age: int | None = None
    max_age: int | None = None
    types: tuple[str, ...] | None = None
    now: int | None = None

    def __post_init__(self):
        for lo, hi, what in ((self.min_size, self.max_size, "size"), (self.min_age, self.max_age, "age")):
            if lo is not None and hi is not None and lo > hi:
                raise ValueError(f"minimum {what} is over the maximum")
        if self.types is not None and not self.types:
            raise ValueError("at least one type must be allowed")

    def matches(self) -> Column:
        out = F.lit(True)
        if self.types is not None:
            out = out & (F.col("tp").isin(*self.types) | ~F.col("tp").isin("F", "D", "L"))
        if self.min_size is not None:
            out = out & (F.col("size") >= self.min_size)
        if self.max_size is not None:
            out = out & (F.col("size") <= self.max_size)
        if self.min_age is not None or self.max_age is not None:
            now = F.lit(self.now).cast("long") if self.now is not None else F.unix_timestamp()
            age = now - F.col("mtime")
            within = F.lit(True)
            if self.min_age is not None:
                within = within & (age >= self.min_age)
            if self.max_age is not None:
                within = within & (age <= self.max_age)
            out = out & ((F.col("mtime") > now) | within)
        return out


@dataclass(frozen=True)
class IgnoreRule:
    regex: str
    negated: bool
    only_dirs: bool


def parse_ignore(content: str) -> list[str]:
    """The patterns of an ignore file: trimmed lines but blanks and comments."""
    return [s for line in content.splitlines() if (s := line.strip()) and not s.startswith("#")]


def ignore_rule(pattern: str) -> IgnoreRule:
    negated = pattern.startswith("!")
    p = pattern[1:] if negated else pattern
    p = p[1:] if p.startswith(("\\#", "\\!")) else p
    only_dirs = p.endswith("/")
    p = p.rstrip("/") if only_dirs else p
    anchored = "/" in p.rstrip("/")
    p = p.lstrip("/")
    glob = p if anchored or p.startswith("**/") else f"**/{p}"
    return IgnoreRule(to_regex(glob, literal_separator=True), negated, only_dirs)


def last_match(path: Column, is_dir: Column, rules: Sequence[IgnoreRule]) -> Column:
    """Whether the last matching rule ignores; rules are few and go inline."""
    out = F.lit(False)
    for r in rules:
        hit = path.rlike(r.regex)
        out = F.when(hit & is_dir if r.only_dirs else hit, not r.negated).otherwise(out)
    return out


def is_ignored(path: Column, is_dir: Column, patterns: Sequence[str]) -> Column:
    """By the path itself or any directory above it."""
    rules = [ignore_rule(p) for p in patterns]
    above = F.exists(paths.ancestors(path), lambda a: last_match(a, F.lit(True), rules))
    return last_match(path, is_dir, rules) | above


def ignore_patterns(spark, files: Sequence[str]) -> list[str]:
    """The patterns of ignore files in order; later files override earlier ones."""
    return [p for f in files for p in parse_ignore(read_text(spark, f))]  # Spark's own readers skip names that begin with a dot


def find_ignore_files(spark, root: str, kinds: Sequence[str] = IGNORE_FILES) -> list[str]:
    """The ignore files that lie in a root folder, in the order of their kinds: the last one overrides."""
    there = set(names(spark, root))
    return [f"{root.rstrip('/')}/{k}" for k in kinds if k in there]


def is_ignored_below(spark, root: str, path: Column, is_dir: Column, kinds: Sequence[str] = IGNORE_FILES) -> Column:
    """Whether the ignore files of the root ignore a path."""
    return is_ignored(path, is_dir, ignore_patterns(spark, find_ignore_files(spark, root, kinds)))


def should_exclude(exclude=(), include=(), ignore=(), properties: PropertyFilter | None = None) -> Column:
    """Globs, ignore files or property filters; cheap tests first."""
    out = is_excluded(F.col("path"), exclude, include)
    if ignore:
        out = out | is_ignored(F.col("path"), F.col("tp") == "D", ignore)
    if properties is not None:
        out = out | (~properties.matches() & (F.col("tp") != "D"))
    return out


def retain(inventory: DataFrame, **rules) -> DataFrame:
    return inventory.filter(~should_exclude(**rules))
