"""Short labels that tell nodes apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import paths

ELLIPSIS = "…"
WIDEST = 14


def common_prefix(low: Column, high: Column) -> Column:
    """Longest common prefix of the least and greatest of some paths, to its last slash."""
    n = F.aggregate(F.sequence(F.lit(0), F.least(F.length(low), F.length(high))), F.lit(0), lambda s, i: F.when(F.left(low, i) == F.left(high, i), i).otherwise(s))
    return F.regexp_replace(F.left(low, n), "[^/]*$", "")


def common_domain(hosts: Column) -> Column:
    """Longest dotted suffix of the first host that ends all hosts; null below two hosts."""
    first = F.split(F.get(hosts, F.lit(0)), "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(first)), lambda i: F.array_join(F.slice(first, i, F.size(first)), "."))
    fit = F.filter(suffixes, lambda s: F.forall(hosts, lambda h: h.endswith(s)))
    return F.when((F.size(hosts) >= 2) & (F.size(first) >= 2), F.get(fit, F.lit(0)))


def short_host(host: Column, domain: Column) -> Column:
    last = F.element_at(F.split(host, "\\."), -1)
    stripped = F.left(host, F.length(host) - F.length(domain) - 1)
    return F.when(host.endswith(F.concat(F.lit("."), domain)), stripped).when(last.rlike(r"^\d*$"), F.concat(F.lit("."), last)).otherwise(host)


def truncate_middle(text: Column, width: int = WIDEST) -> Column:
    """At most ``width`` bytes; the ellipsis counts as three."""
    room = max(width - 3, 0)
    head, tail = (room + 1) // 2, room // 2
    short = F.left(text, F.lit(width)) if width <= 3 else F.concat(F.left(text, F.lit(head)), F.lit(ELLIPSIS), F.right(text, F.lit(tail)))
    return F.when(F.octet_length(text) <= width, text).otherwise(short)


def node_labels(nodes: DataFrame) -> DataFrame:
    """node_idx, location, label of nodes (node_idx, location); a few rows by nature."""
    p = nodes.select("node_idx", "location", paths.location_parts(F.col("location")).alias("p")).select("node_idx", "location", "p.*")
    p = p.withColumn("base", F.coalesce(paths.basename(F.col("path")), F.lit(""))).withColumn("parent", paths.parent_name(F.col("path")))
    facts = p.agg(
        (F.countDistinct("host") == 1).alias("one_host"),
        F.bool_and(~F.col("is_remote")).alias("all_local"),
        common_prefix(F.min("path"), F.max("path")).alias("prefix"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("host") != "local", F.struct("node_idx", "host")))), lambda x: x["host"]).alias("hosts"),
    )
    facts = facts.withColumn("domain", common_domain(F.col("hosts"))).drop("hosts")
    p = p.join(F.broadcast(facts))  # one row
    p = p.withColumn("same_base", F.count(F.lit(1)).over(Window.partitionBy("base")) > 1)
    p = p.withColumn("users", F.size(F.collect_set("user").over(Window.partitionBy("host"))))
    host = F.when(~F.col("all_local") & ~F.col("one_host") & (F.col("host") != "local"), short_host(F.col("host"), F.col("domain")))
    user = F.when(F.col("users") > 1, F.col("user"))
    short = F.when(F.col("path").startswith(F.col("prefix")), F.substr("path", F.length("prefix") + 1)).otherwise(F.col("path"))
    place = (
        F.when(F.col("all_local") & ~F.col("same_base") & (F.col("base") != ""), F.col("base"))
        .when(F.col("same_base"), F.when(F.col("parent").isNotNull(), F.concat_ws("/", "parent", "base")).otherwise(F.col("base")))
        .otherwise(short)
    )
    joined = F.array_join(F.filter(F.array(F.nullif(host, F.lit("")), user, F.when(F.col("same_base"), place).otherwise(F.nullif(place, F.lit("")))), lambda x: x.isNotNull()), ":")
    label = truncate_middle(F.coalesce(F.nullif(joined, F.lit("")), F.nullif("path", F.lit("")), F.col("host")))
    p = p.select("node_idx", "location", label.alias("label"))
    twins = Window.partitionBy("label")
    nth = F.row_number().over(twins.orderBy("node_idx"))
    return p.select("node_idx", "location", F.when(F.count(F.lit(1)).over(twins) > 1, F.concat("label", F.lit("["), nth.cast("string"), F.lit("]"))).otherwise(F.col("label")).alias("label"))
