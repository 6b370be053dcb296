"""Great-circle clustering: places no further apart than a radius share a region."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.functions.geodesy import chord_of_km, haversine_km
from turnout.operators.boxes import (
    AXES,
    DEPTH,
    PAIR_BUDGET,
    STEP,
    boxes,
    grid_steps,
    is_small,
    max_chord,
    min_chord,
    point_pairs,
    prefixed,
    refine,
    root_cell,
    with_position,
)
from turnout.operators.components import connected_components
from turnout.operators.lineage import cut

# Fixed value: neighbourhood radius of a region.
REGION_RADIUS_KM = 50.0
SMALLEST_RADIUS_KM = 0.02  # below this the cell numbers of the globe outgrow a long


def in_cubes(places: DataFrame, radius_km: float) -> DataFrame:
    """Places with their root cube, whose diagonal is the radius: a cube is always one cluster."""
    side = chord_of_km(radius_km) / math.sqrt(3) * (1 - 1e-9)
    steps = {f"f{axis}": grid_steps(axis, side) for axis in AXES}
    cells = [F.shiftright(F.col(f"f{axis}"), DEPTH) + 2 for axis in AXES]
    return with_position(places).withColumns(steps).withColumn("root", root_cell(cells))


def neighbour_offsets() -> list[int]:
    """Half of the cubes within the radius of a cube, as differences of root numbers."""
    reach = range(-2, 3)
    around = [(x, y, z) for x in reach for y in reach for z in reach if (x, y, z) > (0, 0, 0)]
    return [(x << 42) + (y << 21) + z for x, y, z in around]


def _judged(pairs: DataFrame, radius_km: float) -> DataFrame:
    """``linked``: surely within the radius. ``open``: not settled by the bounds. Others go."""
    chord = chord_of_km(radius_km)
    close = haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= radius_km
    single = (F.col("a_n") == 1) & (F.col("b_n") == 1)
    return pairs.where(min_chord() <= chord * (1 + 1e-9)).select(
        "a_root", "a_cell", "b_root", "b_cell", "a_n", "b_n",
        (close | (max_chord() <= chord * (1 - 1e-9))).alias("linked"),
        (~single).alias("open"),
    )


def _edges(linked: DataFrame) -> DataFrame:
    return linked.select(F.col("a_root").alias("u"), F.col("b_root").alias("v"))


def _not_yet_connected(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """Pairs of cubes that no chain of links joins: only there another link makes a difference."""
    clusters = cut(connected_components(_edges(linked)))
    for side in ("a", "b"):
        names = {"node": f"{side}_root", "component": f"{side}_component"}
        pairs = pairs.join(clusters.withColumnsRenamed(names), f"{side}_root", "left")
    component_a = F.coalesce("a_component", "a_root")
    return pairs.where(component_a != F.coalesce("b_component", "b_root"))


def linked_cubes(
    points: DataFrame,
    radius_km: float,
    pair_budget: int,
    worth: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Pairs of neighbouring cubes (u, v) that hold two places within the radius.

    The number of cubes is bounded by the surface of the globe and the radius, whatever the number
    of places. ``worth`` leaves out pairs (a_root, b_root) that need no look.
    """
    cubes = boxes(points, 0)
    offsets = F.expr(f"array({', '.join(f'{offset}L' for offset in neighbour_offsets())})")
    pairs = (
        prefixed(cubes, "a")
        .withColumn("offset", F.explode(offsets))
        .withColumn("b_root", F.col("a_root") + F.col("offset"))
        .join(prefixed(cubes, "b"), "b_root")
    )
    pairs = pairs if worth is None else worth(pairs)
    linked, level = None, 0
    while True:
        judged = cut(_judged(pairs, radius_km))
        found = judged.where("linked").select("a_root", "b_root").distinct()
        linked = found if linked is None else linked.unionByName(found)
        pending = judged.where("open").join(linked, ["a_root", "b_root"], "left_anti")
        small = is_small(pair_budget) if level < DEPTH else F.lit(True)
        near = haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
        direct = point_pairs(pending.where(small), points, level).where(near <= radius_km)
        linked = linked.unionByName(direct.select("a_root", "b_root").distinct())
        if level == DEPTH or judged.where("open").where(~small).isEmpty():
            break
        linked = cut(linked)
        pairs = refine(_not_yet_connected(pending.where(~small), linked), points, level)
        level += STEP
    return _edges(linked)


def check_radius(radius_km: float) -> None:
    if radius_km < SMALLEST_RADIUS_KM:
        raise ValueError(f"radius_km must be at least {SMALLEST_RADIUS_KM}")


def geo_regions(
    events: DataFrame, radius_km: float = REGION_RADIUS_KM, pair_budget: int = PAIR_BUDGET
) -> DataFrame:
    """(competition_id, region): events linked by steps of at most ``radius_km`` share a region.

    Clusters are the connected components of the neighbourhood graph, so every place belongs to
    one, alone or not, and a chain is one region. Its label is its smallest competition id.
    """
    check_radius(radius_km)
    located = in_cubes(events.select("competition_id", "lat", "lon"), radius_km).select(
        "competition_id", "root"
    )
    places = in_cubes(events.select("lat", "lon").distinct(), radius_km)
    joined = connected_components(linked_cubes(places, radius_km, pair_budget))
    cubes = (
        located.groupBy("root")
        .agg(F.min("competition_id").alias("low"))
        .join(joined.withColumnRenamed("node", "root"), "root", "left")
        .select("root", "low", F.coalesce("component", "root").alias("component"))
    )
    labels = cubes.groupBy("component").agg(F.min("low").alias("region"))
    # Dealt out anew, so that the one join of events has an exchange on either side and a cube that
    # holds most events is split.
    region_of = cubes.join(labels, "component").select("root", "region").hint("rebalance")
    return located.join(region_of, "root").select("competition_id", "region")
