"""Points grouped into boxes on the unit sphere, with bounds on the distances between boxes.

Regions and travel spread both ask about pairs of points. Neither lists all pairs: points are
gathered into cubes of a grid, pairs of cubes are settled by bounds where that is possible, and
only pairs that stay open are looked at again on a grid four times finer, or point by point once
few points are left. In three dimensions the poles and the date line need no special care.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.functions.geodesy import unit_sphere

DEPTH = 20  # halvings of a root cube, per axis
STEP = 2  # halvings per refinement
PAIR_BUDGET = 4096  # point pairs that are compared directly
AXES = ("x", "y", "z")


def with_position(points: DataFrame) -> DataFrame:
    x, y, z = unit_sphere(F.col("lat"), F.col("lon"))
    return points.withColumns({"x": x, "y": y, "z": z})


def grid_steps(axis: str, side: float) -> Column:
    """Position along an axis in units of ``side`` / 2^DEPTH, counted from the edge at -1."""
    return F.floor((F.col(axis) + 1.0) / F.lit(side) * F.lit(float(2**DEPTH))).cast("bigint")


def root_cell(axis_cells: list[Column], bits: int = 21) -> Column:
    """Three small non-negative cell numbers as one long."""
    a, b, c = axis_cells
    return F.shiftleft(a, 2 * bits) + F.shiftleft(b, bits) + c


def cell_at(level: int) -> Column:
    """Cell number inside the root cube after ``level`` halvings, from the steps fx, fy, fz."""
    inside = [
        F.shiftright(F.col(f"f{axis}").bitwiseAND(F.lit(2**DEPTH - 1)), DEPTH - level)
        for axis in AXES
    ]
    return root_cell(inside)


def boxes(points: DataFrame, level: int, parent_level: int = 0) -> DataFrame:
    """Tight boxes of the points of each root's cells, with a count and one of the points."""
    extent = [
        bound(axis).alias(f"{name}_{axis}")
        for axis in AXES
        for name, bound in (("min", F.min), ("max", F.max))
    ]
    return points.groupBy(
        "root", cell_at(parent_level).alias("parent"), cell_at(level).alias("cell")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("lat").alias("lat"),
        F.min_by("lon", "lat").alias("lon"),
        *extent,
    )


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def min_chord() -> Column:
    """Lower bound of the chord between a point of box ``a`` and one of box ``b``."""
    gaps = [
        F.greatest(
            F.lit(0.0),
            F.col(f"b_min_{axis}") - F.col(f"a_max_{axis}"),
            F.col(f"a_min_{axis}") - F.col(f"b_max_{axis}"),
        )
        for axis in AXES
    ]
    return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])


def max_chord() -> Column:
    """Upper bound of the chord between a point of box ``a`` and one of box ``b``."""
    spans = [
        F.greatest(
            F.col(f"b_max_{axis}") - F.col(f"a_min_{axis}"),
            F.col(f"a_max_{axis}") - F.col(f"b_min_{axis}"),
        )
        for axis in AXES
    ]
    return F.sqrt(spans[0] * spans[0] + spans[1] * spans[1] + spans[2] * spans[2])


def refine(open_pairs: DataFrame, points: DataFrame, level: int) -> DataFrame:
    """Pairs of the finer boxes inside each open pair of ``level`` boxes.

    ``open_pairs`` has a_root, a_cell, b_root, b_cell. Only cells that are still open are
    subdivided. A cell has at most 4^STEP parts per face of the grid, so one open pair yields a
    bounded number of finer pairs; a cell paired with itself yields each pair of parts once.
    """
    keys = open_pairs.select("a_root", "a_cell", "b_root", "b_cell")
    in_use = (
        keys.select(F.col("a_root").alias("root"), F.col("a_cell").alias("parent"))
        .unionByName(keys.select(F.col("b_root").alias("root"), F.col("b_cell").alias("parent")))
        .distinct()
    )
    still_open = points.withColumn("parent", cell_at(level)).join(
        in_use, ["root", "parent"], "left_semi"
    )
    parts = boxes(still_open.drop("parent"), level + STEP, level)
    itself = (F.col("a_root") == F.col("b_root")) & (F.col("a_parent") == F.col("b_parent"))
    return (
        keys.withColumnsRenamed({"a_cell": "a_parent", "b_cell": "b_parent"})
        .join(prefixed(parts, "a"), ["a_root", "a_parent"])
        .join(prefixed(parts, "b"), ["b_root", "b_parent"])
        .where(~itself | (F.col("a_cell") <= F.col("b_cell")))
    )


def point_pairs(open_pairs: DataFrame, points: DataFrame, level: int) -> DataFrame:
    """The points of each open pair side by side: at most PAIR_BUDGET rows for each."""
    located = points.select("root", cell_at(level).alias("cell"), "lat", "lon")
    return (
        open_pairs.select("a_root", "a_cell", "b_root", "b_cell")
        .join(prefixed(located, "a"), ["a_root", "a_cell"])
        .join(prefixed(located, "b"), ["b_root", "b_cell"])
    )


def is_small(pair_budget: int) -> Column:
    return F.col("a_n") * F.col("b_n") <= pair_budget
