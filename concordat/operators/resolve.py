"""Conflict resolution: strategies, per-path rules and manual choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.globs import to_regex
from ..storage import stored
from .rules import strategies


def winner_position(versions: Column, strategy: str, index: int | None = None, locations: Column | None = None, name: str | None = None) -> Column:
    """struct(position, error) in a list of versions; a null position without error is a skip.

    Ties: the newest and largest go to the last of equals, the oldest and
    smallest to the first.
    """
    n = F.size(versions)
    keyed = lambda field: F.transform(versions, lambda v, i: F.struct(v[field].alias("k"), i.alias("i")))
    none, error = F.lit(None).cast("int"), F.lit(None).cast("string")
    if strategy == "prefer-first":
        position = F.lit(0)
    elif strategy == "prefer-last":
        position = n - 1
    elif strategy in ("prefer-newest", "prefer-largest"):
        position = F.array_max(keyed("mtime" if strategy == "prefer-newest" else "size"))["i"]
    elif strategy in ("prefer-oldest", "prefer-smallest"):
        position = F.array_min(keyed("mtime" if strategy == "prefer-oldest" else "size"))["i"]
    elif strategy == "node-by-index":
        position = F.when(F.lit(index) < n, F.lit(index))
        error = F.when(F.lit(index) >= n, "index out of range")
    elif strategy == "node-by-name":
        at = F.array_position(locations, F.lit(name)).cast("int")
        position, error = F.when(at > 0, at - 1), F.when(at == 0, "unknown node")
    elif strategy == "skip":
        position = none
    elif strategy in ("interactive", "fail"):
        position, error = none, F.lit("needs a choice" if strategy == "interactive" else "conflict")
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    position = F.when(n > 0, position.cast("int"))
    return F.struct(position.alias("position"), F.when(n == 0, "no versions").otherwise(error).alias("error"))


def resolve(conflicts: DataFrame, strategy: str, index: int | None = None, name: str | None = None, node_names: Sequence[str] = ()) -> DataFrame:
    """conflicts (path, versions) with winner_node and error; positions are mapped to nodes."""
    names = F.array(*map(F.lit, node_names)) if node_names else F.array().cast("array<string>")
    locations = F.transform("versions", lambda v: F.get(names, v["node_idx"]))
    picked = winner_position(F.col("versions"), strategy, index, locations, name)
    return conflicts.withColumn("_p", picked).select("path", "versions", F.get("versions", F.col("_p.position"))["node_idx"].alias("winner_node"), F.col("_p.error").alias("error"))


def strategy_for(path: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The strategy of the first glob that matches; rules are few and go inline."""
    out = F.lit(default)
    for pattern, strategy in reversed(rules):
        out = F.when(path.rlike(to_regex(pattern)), strategy).otherwise(out)
    return out


def strategy_by_table(paths: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for a rules table (priority, pattern, strategy) that is data, of any size."""
    return strategies(paths, rules, default)


def resolve_by_rules(conflicts: DataFrame, rules: Sequence[tuple[str, str]], default: str) -> DataFrame:
    rows = conflicts.withColumn("strategy", strategy_for(F.col("path"), rules, default))
    picked = None
    for s in dict.fromkeys([*(r[1] for r in rules), default]):
        p = winner_position(F.col("versions"), s)
        picked = F.when(F.col("strategy") == s, p) if picked is None else picked.when(F.col("strategy") == s, p)
    return rows.withColumn("_p", picked).select("path", "strategy", F.get("versions", F.col("_p.position"))["node_idx"].alias("winner_node"), F.col("_p.error").alias("error"))


def manual(conflicts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """path, winner_node: the first choice of a path that names a present version.

    resolutions: seq, path, chosen_node (a position in versions); later, invalid
    and foreign ones are ignored, unmentioned conflicts stay unresolved (null).
    """
    n = conflicts.select("path", "versions")
    valid = resolutions.join(n, "path").filter((F.col("chosen_node") >= 0) & (F.col("chosen_node") < F.size("versions")))
    first = valid.groupBy("path").agg(F.min(F.struct("seq", "chosen_node")).alias("c"))
    return n.join(first, "path", "left").select("path", F.get("versions", F.col("c.chosen_node"))["node_idx"].alias("winner_node"))


def next_unresolved(conflicts: DataFrame) -> DataFrame:
    """Each conflict's next unresolved one in path order; null at the end.

    Paths are dealt to ranges; within one a window looks ahead, and the first
    unresolved path of each later range (a row per range) carries on.
    """
    parts = int(conflicts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = conflicts.select("path", "resolved").repartitionByRange(parts, "path").select(F.spark_partition_id().alias("part"), "path", "resolved")
    rows = stored(rows, "conflicts-in-order")
    open_ = F.when(~F.col("resolved"), F.col("path"))
    later = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("part").agg(F.min(open_).alias("first")).select("part", F.min("first").over(later).alias("beyond"))
    ahead = Window.partitionBy("part").orderBy("path").rowsBetween(1, Window.unboundedFollowing)
    out = rows.select("part", "path", F.first(open_, ignorenulls=True).over(ahead).alias("next"))
    return out.join(F.broadcast(firsts), "part").select("path", F.coalesce("next", "beyond").alias("next_path"))


def resolution_counts(conflicts: DataFrame) -> DataFrame:
    """One row: n_conflicts, n_resolved, n_unresolved, and ready (nothing is left to choose)."""
    left = F.count_if(~F.col("resolved"))
    return conflicts.agg(F.count(F.lit(1)).alias("n_conflicts"), F.count_if(F.col("resolved")).alias("n_resolved"), left.alias("n_unresolved"), (left == 0).alias("ready"))
