"""How far apart the places are that a person travels to."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.functions.geodesy import haversine_km, km_of_chord
from turnout.operators.boxes import (
    AXES,
    DEPTH,
    PAIR_BUDGET,
    STEP,
    grid_steps,
    is_small,
    max_chord,
    point_pairs,
    refine,
    with_position,
)
from turnout.operators.lineage import cut

# Who counts as a local.
MAX_SPREAD_KM = 250.0
MAX_REGIONS = 3

POINTS_IN_ROW = 256  # places of a person that are compared inside one row


def _directions() -> tuple[list[tuple[float, float, float]], float]:
    """Axes through the corners, faces and edges of a cube, and the cosine of the farthest angle to one.

    They cut the sphere into 48 equal triangles with an axis at every corner. No direction is farther
    from all axes than a corner is from the middle of its triangle's circle.
    """
    axes = [a for a in product((-1, 0, 1), repeat=3) if a > (0, 0, 0)]
    units = [tuple(c / math.sqrt(sum(d * d for d in a)) for c in a) for a in axes]
    face, edge, corner = (1.0, 0.0, 0.0), (0.5**0.5, 0.5**0.5, 0.0), (3**-0.5,) * 3
    u, v = ([b - a for a, b in zip(face, other)] for other in (edge, corner))
    normal = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    return units, abs(normal[0]) / math.sqrt(sum(c * c for c in normal))


DIRECTIONS, NARROWEST = _directions()


def _along(direction: tuple[float, float, float]) -> Column:
    """How far a place on the unit sphere lies along a direction."""
    return sum((F.col(axis) * F.lit(c) for axis, c in zip(AXES[1:], direction[1:])), F.col("x") * F.lit(direction[0]))


def _extent(columns: bool) -> list[Column]:
    """Least and greatest position along every direction: of places, or of such columns."""
    out = []
    for k, direction in enumerate(DIRECTIONS):
        low, high = (F.col(f"low{k}"), F.col(f"high{k}")) if columns else (_along(direction),) * 2
        out += [F.min(low).alias(f"low{k}"), F.max(high).alias(f"high{k}")]
    return out


def _may_be_farthest() -> Column:
    """Whether a place can be an end of a person's longest chord, by the person's extent.

    Some chord is at least as long as the greatest width of the extent. From a place, no other is
    farther than the extent along the direction that is nearest to the way there, widened by the angle
    between them. So a place from which the extent reaches less far than that is no end.
    """
    ways = [F.greatest(F.col(f"high{k}") - _along(d), _along(d) - F.col(f"low{k}")) for k, d in enumerate(DIRECTIONS)]
    widths = [F.col(f"high{k}") - F.col(f"low{k}") for k in range(len(DIRECTIONS))]
    return F.greatest(*ways) >= F.greatest(*widths) * F.lit(NARROWEST * (1 - 1e-9)) - F.lit(1e-12)


def _widest_km(places: Column) -> Column:
    """Largest great-circle distance within a short array of struct(lat, lon)."""

    def farthest_from(p: Column) -> Column:
        return F.array_max(
            F.transform(places, lambda q: haversine_km(p["lat"], p["lon"], q["lat"], q["lon"]))
        )

    return F.array_max(F.transform(places, farthest_from))


def _spread_of_many(places: DataFrame, pair_budget: int) -> DataFrame:
    """Farthest pair per person by halving boxes.

    A pair of boxes is dropped once its upper bound cannot beat the best distance found so far
    between two real places of the person. What stays is split further, or compared place by
    place once it is down to ``pair_budget`` pairs. No person's places are gathered anywhere.
    """
    steps = {f"f{axis}": F.least(grid_steps(axis, 2.0), F.lit(2**DEPTH - 1)) for axis in AXES}
    points = cut(
        with_position(places).withColumns(steps).withColumnRenamed("person_id", "root")
        .select("root", "lat", "lon", *AXES, *steps)
    )
    whole = F.lit(0).cast("bigint")
    pairs = points.select(
        F.col("root").alias("a_root"), whole.alias("a_cell"),
        F.col("root").alias("b_root"), whole.alias("b_cell"),
    ).distinct()
    between = haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    level, best = 0, None
    while True:
        parts = refine(pairs, points, level)
        level += STEP
        measured = cut(
            parts.select(
                "a_root", "a_cell", "b_root", "b_cell", "a_n", "b_n",
                between.alias("lower"),
                (km_of_chord(max_chord()) * (1 + 1e-9) + 1e-9).alias("upper"),
            )
        )
        found = measured.groupBy("a_root").agg(F.max("lower").alias("km"))
        best = found if best is None else best.unionByName(found)
        beaten = best.groupBy("a_root").agg(F.max("km").alias("best"))
        pending = (
            measured.where("a_n > 1 or b_n > 1")
            .join(beaten, "a_root")
            .where(F.col("upper") > F.col("best"))
        )
        small = is_small(pair_budget) if level < DEPTH else F.lit(True)
        direct = point_pairs(pending.where(small), points, level)
        best = best.unionByName(direct.groupBy("a_root").agg(F.max(between).alias("km")))
        large = pending.where(~small)
        if level == DEPTH or large.isEmpty():
            break
        best = cut(best.groupBy("a_root").agg(F.max("km").alias("km")))
        pairs = large
    return best.groupBy(F.col("a_root").alias("person_id")).agg(F.max("km").alias("spread_km"))


def person_spread(
    attendance: DataFrame, points_in_row: int = POINTS_IN_ROW, pair_budget: int = PAIR_BUDGET
) -> DataFrame:
    """Per person: starts, different regions and the largest distance between any two places.

    ``attendance`` has person_id, region, lat, lon, one row per start. Starts at one place are merged
    first. Persons with up to ``points_in_row`` places are measured inside one row; the number is
    checked. Of the others, the extent of the places along fixed directions rules out all that cannot be
    an end of the longest distance; few stay, and if they are still more than a row takes, the box
    search measures them. Everything is exact, and nobody's places are gathered unchecked.
    """
    places = cut(
        attendance.groupBy("person_id", "region", "lat", "lon").agg(F.count(F.lit(1)).alias("starts"))
    )
    busy = _persons_with_more(places, points_in_row)
    if busy.isEmpty():
        return _measured_in_row(places)
    # Dealt out anew: places of a busy person are split by the joins below.
    few = _measured_in_row(places.join(busy, "person_id", "left_anti"))
    ends = _ends(places.join(busy, "person_id", "left_semi"))
    still = _persons_with_more(ends, points_in_row)
    stats = ends.groupBy("person_id").agg(F.max("n_starts").alias("n_starts"), F.max("n_regions").alias("n_regions"))
    if still.isEmpty():
        return few.unionByName(stats.join(_widest(ends), "person_id"))
    searched = _spread_of_many(ends.join(still, "person_id", "left_semi").select("person_id", "lat", "lon"), pair_budget)
    measured = _widest(ends.join(still, "person_id", "left_anti")).unionByName(searched)
    return few.unionByName(stats.join(measured, "person_id"))


def _persons_with_more(places: DataFrame, limit: int) -> DataFrame:
    counted = places.groupBy("person_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return counted.select("person_id").hint("rebalance")


def _ends(places: DataFrame) -> DataFrame:
    """The places that can be an end of a person's longest distance, with the person's starts and regions.

    One aggregate per person and region, and one per person, give the extents; they merge in any order
    and are as long for a busy person as for others.
    """
    positions = with_position(places)
    per_region = positions.groupBy("person_id", "region").agg(F.sum("starts").alias("starts"), *_extent(False))
    extents = per_region.groupBy("person_id").agg(
        F.sum("starts").alias("n_starts"), F.count("region").alias("n_regions"), *_extent(True)
    )
    return cut(
        positions.join(extents.hint("rebalance"), "person_id")
        .where(_may_be_farthest())
        .select("person_id", "n_starts", "n_regions", "lat", "lon")
    )


def _widest(places: DataFrame) -> DataFrame:
    rows = places.groupBy("person_id").agg(F.collect_list(F.struct("lat", "lon")).alias("places"))
    return rows.select("person_id", _widest_km(F.col("places")).alias("spread_km"))


def _measured_in_row(places: DataFrame) -> DataFrame:
    """Everything about persons with few places, by one aggregate."""
    rows = places.groupBy("person_id").agg(
        F.sum("starts").alias("n_starts"),
        F.size(F.collect_set("region")).cast("long").alias("n_regions"),
        F.collect_list(F.struct("lat", "lon")).alias("places"),
    )
    return rows.select("person_id", "n_starts", "n_regions", _widest_km(F.col("places")).alias("spread_km"))


def is_local(max_spread_km: float = MAX_SPREAD_KM, max_regions: int = MAX_REGIONS) -> Column:
    return (F.col("spread_km") <= max_spread_km) & (F.col("n_regions") <= max_regions)
