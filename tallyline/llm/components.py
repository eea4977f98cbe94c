"""Connected components by alternating stars; edges and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._spark import keyed_join, stage


def _toward_min(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """Connect each node's neighbours to the smallest of them and itself: those above the node (large) or not above it.

    There are n edges at most.
    """
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    both = keyed_join(near, low, ["a"], "n", 2 * n if large else n)
    if large:
        out = both.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = both.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of edges (a bigint, b bigint).

    Rounds of large and small stars until the edges stand still, which takes of the order
    of log^2 of the nodes; every round writes its edges to the shared folder. The hub of
    a star is the hot key of a join: hubs are few and broadcast, see keyed_join. Loops
    and repeated edges change nothing; no edges give no rows.
    """
    now = stage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    mark, new = None, (now.count(),)
    while new != mark:
        mark = new
        # a large star keeps at most one edge of each that it is given
        now = stage(_toward_min(_toward_min(now, mark[0], True), mark[0], False), "edges")
        new = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("b", "a").cast("bigint"))).first())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
