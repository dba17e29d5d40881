"""Capability-aware metadata comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: owner, permissions, timestamps, xattrs, tolerance in seconds by preset (fixed values);
#: smart compares owners only as root; -1 is no limit.
PRESETS = {"strict": (True, True, True, True, 0), "smart": (False, True, True, False, 1), "relaxed": (False, False, True, False, 2), "content-only": (False, False, False, False, -1)}
POLICY = ("compare_owner", "compare_permissions", "compare_timestamps", "compare_xattrs", "tolerance")


def preset(name: str, root: bool = False) -> dict[str, Column]:
    owner, *rest = PRESETS[name]
    return dict(zip(POLICY, map(F.lit, (owner or (name == "smart" and root), *rest)), strict=True))


def _policy(owner: Column, rights: Column, xattrs: Column, sensitive: Column, empty: str) -> list[Column]:
    some = F.count(F.lit(1)) > 0
    d = preset(empty)
    values = (owner, rights, F.lit(True), xattrs, F.when(sensitive, 1).otherwise(2))
    return [F.when(some, v).otherwise(d[c]).alias(c) for c, v in zip(POLICY, values, strict=True)]


def least_common(caps: DataFrame, *by: str) -> DataFrame:
    """Compare only what all nodes (of each group) can keep; no node: content only."""
    return caps.groupBy(*by).agg(*_policy(F.bool_and("can_chown"), F.bool_and("can_chmod"), F.bool_and("can_set_xattrs"), F.bool_and("case_sensitive"), "content-only"))


def best_effort(caps: DataFrame, *by: str) -> DataFrame:
    """Compare what any node (of each group) can keep; no node: smart."""
    return caps.groupBy(*by).agg(*_policy(F.bool_or("can_chown"), F.bool_or("can_chmod"), F.bool_or("can_set_xattrs"), F.bool_and("case_sensitive"), "smart"))


def source_wins(caps: DataFrame, node_idx: int, *by: str) -> DataFrame:
    """Compare what one node can keep; an unknown node: least common."""
    own = lambda c: F.bool_or(F.when(F.col("node_idx") == node_idx, F.col(c)))
    pick = lambda c: F.coalesce(own(c), F.bool_and(c))
    return caps.groupBy(*by).agg(*_policy(pick("can_chown"), pick("can_chmod"), pick("can_set_xattrs"), pick("case_sensitive"), "content-only"))


def differs(a: str, b: str, policy: dict[str, Column]) -> Column:
    """Whether structs a and b of file fields differ under a policy."""
    f = lambda side, c: F.col(f"{side}.{c}")
    far = (policy["tolerance"] >= 0) & (F.abs(f(a, "mtime") - f(b, "mtime")) > policy["tolerance"])
    return (
        (f(a, "size") != f(b, "size"))
        | (f(a, "tp") != f(b, "tp"))
        | (policy["compare_timestamps"] & far)
        | (policy["compare_permissions"] & (f(a, "mode") != f(b, "mode")))
        | (policy["compare_owner"] & ((f(a, "uid") != f(b, "uid")) | (f(a, "gid") != f(b, "gid"))))
    )


def metadata_differs(inventory: DataFrame, first: int, second: int, policy: dict[str, Column]) -> DataFrame:
    """path, differs for the paths that two nodes both have."""
    fields = F.struct("tp", "mode", "uid", "gid", "mtime", "size")
    side = lambda n: F.max(F.when(F.col("node_idx") == n, fields))
    rows = inventory.filter(F.col("node_idx").isin(first, second)).groupBy("path").agg(side(first).alias("a"), side(second).alias("b"))
    return rows.filter("a is not null and b is not null").select("path", differs("a", "b", policy).alias("differs"))


def default_capabilities() -> dict:
    """What is assumed of a node that was not asked."""
    return {"can_set_xattrs": False, "filesystem_type": None, "case_sensitive": True}


def is_root(effective_uid: Column) -> Column:
    return effective_uid == 0
