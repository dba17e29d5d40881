"""Connected components of an edge table, by alternating large and small stars.

Every pass replaces edges by edges to smaller neighbours; passes needed grow
with the logarithm of a component's size.  A pass aggregates minima (partial
sums first), writes them and joins them back on the node: a hub is then a skewed
key of a join of plain inputs, which adaptive execution splits; no neighbour list is ever gathered, and nothing
but two numbers for the stop test goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, few_tasks, materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the component's least node) of every node of edges (a, b); materialised.

    Nodes are non-null and orderable; loops, repeats and either direction are
    allowed.  A node without an edge is absent: it is its own root.  Each pass writes as few
    files as its rows ask for: with many shuffle partitions and few edges, tasks are what it costs.
    """
    up = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = materialize(few_tasks(edges.select(*up).filter("a <> b").distinct(), edges.count()), name)
    state = _state(now)
    while state[0]:
        # No table of a pass has more than two rows an edge.
        kept = lambda df: materialize(few_tasks(df, 2 * state[0]), name)  # noqa: B023, E731
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = kept(large.select(*up))
        low = kept(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        discard(now, least)
        now = kept(small.select("e.*").select(*up).filter("a <> b").distinct())
        discard(large, low)
        was, state = state, _state(now)
        if was == state:
            break
    # Every edge now goes to a root.
    roots = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))).alias("e"))
    out = materialize(few_tasks(roots.select("e.*").groupBy("node").agg(F.min("root").alias("root")), 2 * state[0]), name)
    discard(now)
    return out
