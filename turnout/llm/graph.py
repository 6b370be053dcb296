"""Connected components of links between documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.llm.common import apart, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); the component is its smallest node.

    Large-star and small-star steps take turns (Kiveris et al., 2014), so long chains need few
    rounds too. A round is stored before the next one begins. The neighbours of a hub are combined
    before the shuffle, and joined back from two plain exchanges, which adaptive execution can split.
    """
    edges = stored(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u <> v")
        .distinct(),
        "edges",
    )
    while not _finished(edges):
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(
            ends.where("v > u")
            .join(apart(nearest.withColumnRenamed("u", "at")), F.col("u") == F.col("at"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct(),
            "large",
        )
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(apart(parent.withColumnRenamed("u", "at")), F.col("u") == F.col("at"))
        edges = stored(
            small.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(parent.select("u", F.col("m").alias("v")))
            .distinct(),
            "edges",
        )
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _finished(edges: DataFrame) -> bool:
    """Every node has one parent at most, and no parent has a parent."""
    parents = edges.groupBy(F.col("u").alias("node")).agg(
        F.count("*").alias("parents"), F.lit(0).cast("long").alias("children")
    )
    children = edges.groupBy(F.col("v").alias("node")).agg(
        F.lit(0).cast("long").alias("parents"), F.count("*").alias("children")
    )
    nodes = parents.unionByName(children).groupBy("node").agg(
        F.sum("parents").alias("parents"), F.sum("children").alias("children")
    )
    return nodes.where("parents > 1 or (parents > 0 and children > 0)").isEmpty()


def merged(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``label``, the smallest member of each row's class, after the links (left, right) join classes."""
    known = np.flatnonzero(label != np.arange(len(label)))
    left, right = np.concatenate([label[left], known]), np.concatenate([label[right], label[known]])
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect what the links (left, right) connect; fewer than ``n``."""
    label = merged(np.arange(n), left, right)
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]
