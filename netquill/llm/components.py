"""Connected components by alternating large-star and small-star steps; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Edges (u, v) with u > v, re-hung: each node's larger (or smaller) neighbours are linked to the least node it sees."""
    around = edges if small else edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = around.join(least, "u")
    moved = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) if small else hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are stars: no u has two of them or is the v of another. Then each v, being less, is its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return (seen.agg(F.max(F.col("up") + F.col("down"))).first()[0] or 0) <= 1


def connected_components(links: DataFrame, a: str, b: str, found: DataFrame | None = None) -> DataFrame:
    """``node, component`` (the least node reachable) for each node that has a link. Nulls and self links are ignored.

    ``found`` is what an earlier call gave; its components stand for the links that made them, which needn't be given again."""
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    if found is not None:
        edges = edges.unionByName(found.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")))
    edges = materialize(edges.distinct(), "components")  # a round reads its edges eight times: their own plan isn't repeated in it
    while not _settled(edges):
        edges = materialize(_star(_star(edges, small=False), small=True), "components")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
