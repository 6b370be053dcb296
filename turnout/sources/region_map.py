"""Regions of a map that grows: new events are linked to their neighbourhood, the rest stays as it is.

The map holds the places by tile, every cube with its component and smallest event, and the cube of
every event. New places change their cubes; only pairs with a changed cube are looked at, and only if no
chain joins them yet. What they link are components as wholes, so a region of any size is one node of
the graph that is searched. The number of cubes is bounded by the surface of the globe.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.operators.boxes import PAIR_BUDGET
from turnout.operators.components import connected_components
from turnout.operators.lineage import cut
from turnout.operators.regions import REGION_RADIUS_KM, check_radius, in_cubes, linked_cubes, neighbour_offsets
from turnout.sources import versions
from turnout.sources.versions import Table, Version

# Cubes along an axis of a tile, as a power of two, and the bits of a cube number along an axis.
TILE_BITS, AXIS_BITS = 4, 21

_TABLES = {
    "places": "lat double, lon double, root bigint, tile bigint",
    "cubes": "root bigint, low string, component bigint",
    "events": "competition_id string, root bigint",
}


def _tile(root: Column) -> Column:
    """The tile of a cube: the cube's numbers along the axes without their last bits."""
    mask = ((1 << AXIS_BITS) - 1) >> TILE_BITS << TILE_BITS
    return root.bitwiseAND(F.lit(mask << 2 * AXIS_BITS | mask << AXIS_BITS | mask))


def create_map(spark: SparkSession, directory: str, radius_km: float = REGION_RADIUS_KM) -> Version:
    """An empty map for regions of a radius. Fails if the directory has one."""
    check_radius(radius_km)
    if versions.numbers(spark, directory):
        raise ValueError(f"{directory} holds a map already")
    tables = {name: Table(spark.createDataFrame([], ddl).schema, {}) for name, ddl in _TABLES.items()}
    return versions.publish(spark, directory, Version(1, tables, {"radius_km": radius_km}))


def add_events(spark: SparkSession, directory: str, events: DataFrame, pair_budget: int = PAIR_BUDGET) -> Version:
    """Add events (competition_id, lat, lon) and publish the map's next version.

    After any batches in any order the regions equal those of all events at once. An event may come
    again as it is, or at a further place, which then links as one more event of that name. A run
    that fails leaves the map as it was.
    """
    before = versions.current(spark, directory)
    if before is None:
        raise ValueError(f"no map in {directory}")
    radius = float(before.settings["radius_km"])
    folder = versions.new_folder()
    around = F.array(*[F.lit(o).cast("long") for half in neighbour_offsets() for o in (half, -half)], F.lit(0).cast("long"))

    located = in_cubes(events.select("competition_id", "lat", "lon"), radius)
    located = located.select("competition_id", "lat", "lon", "root").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cubes = versions.read_part(spark, directory, before.tables["cubes"])
        # Places within reach of the new ones: their tiles are read, and of these their cubes.
        arrived = located.select("lat", "lon", "root").distinct()
        reach = arrived.select("root").distinct().select(F.explode(F.transform(around, lambda o: F.col("root") + o)).alias("root")).distinct()
        tiles = [r["tile"] for r in reach.select(_tile(F.col("root")).alias("tile")).distinct().collect()]
        near = versions.read_part(spark, directory, before.tables["places"], tiles).join(reach, "root", "left_semi")
        fresh = cut(arrived.join(near.select("lat", "lon"), ["lat", "lon"], "left_anti").select("lat", "lon", "root"))
        changed = fresh.select("root").distinct()

        def worth(pairs: DataFrame) -> DataFrame:
            return _unsettled(pairs, changed, cubes)

        points = in_cubes(near.select("lat", "lon").unionByName(fresh.select("lat", "lon")), radius)
        links = linked_cubes(points, radius, pair_budget, worth)
        own = cubes.select("root", "component")
        named = links.distinct()
        for end in ("u", "v"):
            names = own.select(F.col("root").alias(end), F.col("component").alias(f"{end}_old"))
            named = named.join(names, end, "left").withColumn(end, F.coalesce(f"{end}_old", end)).drop(f"{end}_old")
        joined = cut(connected_components(named))

        lows = located.groupBy("root").agg(F.min("competition_id").alias("low"), F.first("root").alias("component"))
        every = cubes.select("root", "low", "component", F.lit(1).alias("known")).unionByName(
            lows.select("root", "low", "component", F.lit(0).alias("known"))
        )
        # A cube that is known keeps its component's name until the links say otherwise.
        merged = every.groupBy("root").agg(F.min("low").alias("low"), F.max_by("component", "known").alias("old"))
        renamed = merged.join(joined.withColumnRenamed("node", "old"), "old", "left")
        staged = {
            "cubes": versions.stage(
                renamed.select("root", "low", F.coalesce("component", "old").alias("component")), directory, f"{folder}/cubes"
            ),
            "places": versions.stage(fresh.withColumn("tile", _tile(F.col("root"))), directory, f"{folder}/places", "tile"),
            "events": versions.stage(_new_rows(located, before, directory), directory, f"{folder}/events"),
        }
    finally:
        located.unpersist()
    tables = {
        name: before.tables[name].with_parts(table.parts, append=name != "cubes") for name, table in staged.items()
    }
    return versions.publish(spark, directory, replace(before, number=before.number + 1, tables=tables))


def _unsettled(pairs: DataFrame, changed: DataFrame, cubes: DataFrame) -> DataFrame:
    """Pairs with a cube that has new places, unless a chain of links joins the two cubes already."""
    for end in ("a", "b"):
        marks = changed.select(F.col("root").alias(f"{end}_root"), F.lit(True).alias(f"{end}_new"))
        names = cubes.select(F.col("root").alias(f"{end}_root"), F.col("component").alias(f"{end}_of"))
        pairs = pairs.join(marks, f"{end}_root", "left").join(names, f"{end}_root", "left")
    settled = F.coalesce(F.col("a_of") == F.col("b_of"), F.lit(False))
    has_new = F.col("a_new").isNotNull() | F.col("b_new").isNotNull()
    return pairs.where(has_new & ~settled).drop("a_new", "b_new", "a_of", "b_of")


def _new_rows(located: DataFrame, before: Version, directory: str) -> DataFrame:
    rows = located.select("competition_id", "root").distinct()
    stored = versions.read_part(located.sparkSession, directory, before.tables["events"])
    return rows.join(stored, ["competition_id", "root"], "left_anti")


def map_regions(spark: SparkSession, directory: str, number: int | None = None) -> DataFrame:
    """(competition_id, region) of the map, as ``geo_regions`` has them."""
    version = versions.current(spark, directory, number)
    if version is None:
        raise ValueError(f"no map in {directory}")
    cubes, events = (versions.read_part(spark, directory, version.tables[name]) for name in ("cubes", "events"))
    labels = cubes.groupBy("component").agg(F.min("low").alias("region"))
    region_of = cubes.join(labels, "component").select("root", "region").hint("rebalance")
    return events.join(region_of, "root").select("competition_id", "region")
