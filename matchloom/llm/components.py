"""Connected components of an edge table by alternating large and small stars, all in joins and aggregates.

Each round hangs a node's larger neighbours on its least one, then all smaller ones; the edges end as one star per
component. Aggregates combine before the shuffle and the joins may be split, so a node with very many edges is no
single task's work. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.sources.staging import stage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges run from the larger node a to the smaller one b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other node at most, and none that others hang on does."""
    sides = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    roles = sides.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return not roles.where("hangs > 1 OR hangs + holds > 1").limit(1).count()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, part) of every node that has an edge in (a, b); part is the least node of the component."""
    now = stage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    while not _are_stars(now):
        now = stage(_small_star(_large_star(now)), "edges")
    members = now.select(F.col("a").alias("node"), F.col("b").alias("part"))
    return members.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("part")).distinct())


def merged_components(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """Components after more edges: those of (node, part) and the new (a, b) together; unchanged without new ones."""
    if not edges.limit(1).count():
        return parts
    stars = parts.where("node <> part").select(F.col("node").alias("a"), F.col("part").alias("b"))
    return connected_components(stars.unionByName(edges.select("a", "b")))
