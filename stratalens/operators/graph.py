"""kNN graphs and personalised PageRank on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalens.functions import geo


def edge_weights(knn: DataFrame, tau: float) -> DataFrame:
    """(src, dst, sim) to (src, dst, w): exp((sim - 1) / tau), each source's weights adding to 1."""
    raw = knn.withColumn("w", F.exp((F.col("sim") - 1) / tau))
    return raw.withColumn("w", F.col("w") / F.sum("w").over(W.partitionBy("src"))).select("src", "dst", "w")


def limit_edges(edges: DataFrame, far) -> DataFrame:
    """Edges under the condition ``far`` are cut; their weight stays at the source as a self edge."""
    cut = edges.where(far.isNotNull()).select("src", F.when(far, F.col("src")).otherwise(F.col("dst")).alias("dst"), "w")
    return cut.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def diffuse(seeds: DataFrame, edges: DataFrame, steps: int, alpha: float, top: int, own: str | None = "own", start: DataFrame | None = None) -> DataFrame:
    """Personalised PageRank of many queries at once: seeds(q, node, p[, own]) over edges(src, dst, w).

    Each step spreads, mixes the seeds back, zeroes the query's own node, keeps the ``top`` nodes of
    a query and renormalises.  Steps are few and fixed, so the plan stays short.  ``start``(q, node, p)
    is where earlier steps came to, if there were any.
    """
    # Each seed's share is kept apart from what is spread, so that the sums are those of one pass.
    now = seeds.select("q", "node", "p") if start is None else start
    owner = seeds.select("q", own).distinct() if own else None
    for _ in range(steps):
        spread = now.join(edges, now.node == edges.src).select("q", F.col("dst").alias("node"), (F.col("p") * F.col("w") * alpha).alias("p"))
        mixed = spread.unionByName(seeds.select("q", "node", (F.col("p") * (1 - alpha)).alias("p"))).groupBy("q", "node").agg(F.sum("p").alias("p"))
        if owner is not None:
            mixed = mixed.join(owner, "q").withColumn("p", F.when(F.col("node") == F.col(own), 0.0).otherwise(F.col("p"))).drop(own)
        by = W.partitionBy("q").orderBy(F.desc("p"), "node")
        cut = mixed.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= top)
        now = cut.withColumn("p", F.col("p") / F.sum("p").over(W.partitionBy("q"))).select("q", "node", "p")
    return now


def area_mass(nodes: DataFrame, areas: DataFrame, radius_km: float, top: int) -> DataFrame:
    """(q, area, mass, pick) of nodes(q, node, p, lat, lon) and areas(q, area, clat, clon).

    ``mass`` is what lies within the radius (<) of the area's centre; ``pick`` is the one of a query's
    ``top`` nodes with the most of their mass around it.  Both joins are within a query, whose nodes
    are a truncated list.
    """
    near = geo.haversine("clat", "clon", "lat", "lon") < radius_km
    mass = areas.join(nodes, "q").groupBy("q", "area").agg(F.coalesce(F.sum(F.when(near, F.col("p"))), F.lit(0.0)).alias("mass"))
    by = W.partitionBy("q").orderBy(F.desc("p"), "node")
    a = nodes.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= top).select("q", "node", "p", "lat", "lon")
    b = a.select("q", F.col("p").alias("p2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    around = a.join(b, "q").where(geo.haversine("lat", "lon", "lat2", "lon2") < radius_km).groupBy("q", "node").agg(F.sum("p2").alias("near"))
    pick = around.groupBy("q").agg(F.max_by("node", F.struct(F.round("near", 9), -F.col("node"))).alias("pick"))
    return mass.join(pick, "q")
