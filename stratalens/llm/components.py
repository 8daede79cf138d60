"""Connected components of an edge table, without collecting edges anywhere.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
and Beyond"): each step rewires edges to the smallest neighbour, so that every component ends
as a star around its smallest node.  The smallest neighbour comes from a grouped minimum
(combined before the shuffle), written, and joined back to the edges on their node: both sides
of that join are plain shuffles with a row a node on one of them, so adaptive execution can split
a hot node's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import forget, written


def _star(edges: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    """Large star (node "u", with both directions given): v > u gets u's least neighbour; small star: the same over v < u.  With the written minima."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    joined = edges.join(least.hint("shuffle_merge"), "u")
    if node == "large":
        m = F.least("m", "u")
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), m.alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u <> v").distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """(u, v) with u > v, any orderable type, to (node, root): every node but roots, once, with its component's least node.

    Rounds go on until the edges settle, as many as it takes; a round's tables go when the next is written.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, of_large = _star(both, "large")
        small, of_small = _star(large, "small")
        before, now = now, written(small, "edges")
        forget(before, of_large, of_small)
        # A fixed point is reached when the edge set repeats: count and an order-free sum of hashes.
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen.n == 0 or (seen.n, seen.h) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (seen.n, seen.h)
