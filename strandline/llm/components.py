"""Connected components by alternating large-star and small-star over a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.tables import settled


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest of node and neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest neighbour; ``u > v`` in every row."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``(u, v)`` links between integer ids to ``(id, component)``, the smallest reachable id.

    Links are undirected, may repeat, and may join a node to itself; rows with a null end
    are ignored. Ids that have no link to another id are not returned. Each round
    is written to the shared folder; only two numbers per round reach the driver. A hot
    node is reduced by a partial minimum, and its rows join back in skew-splittable joins.
    """
    edges = (
        links.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    edges = settled(edges, "links")
    seen = None
    while True:
        edges = settled(_small_star(_large_star(edges)), "links")
        now = edges.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u") % (1 << 31)).alias("s")
        ).first()
        if now["n"] == 0 or now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
