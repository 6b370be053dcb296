"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.operators.lineage import cut


def _are_stars(edges: DataFrame) -> bool:
    """Every node has one parent at most, and no parent has a parent."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("u").alias("node"), F.lit(1).alias("parents"), F.lit(0).alias("children")),
                F.struct(F.col("v").alias("node"), F.lit(0).alias("parents"), F.lit(1).alias("children")),
            )
        ).alias("e")
    ).select("e.*")
    degrees = ends.groupBy("node").agg(
        F.sum("parents").alias("parents"), F.max("children").alias("children")
    )
    return degrees.where("parents > 1 or (parents > 0 and children > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); the component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014), which need
    O(log^2 n) rounds also on long chains. Each round is two aggregates and two joins, and ends
    in a checkpoint.
    """
    edges = cut(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u <> v")
        .distinct()
    )
    while not _are_stars(edges):
        ends = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(
            edges.select(F.col("v").alias("node"), F.col("u").alias("other"))
        )
        nearest = ends.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("m"))
        large = (
            ends.where("other > node")
            .join(nearest, "node")
            .select(F.col("other").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(parent, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(parent.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = cut(small)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
