"""Where people go: densities, regions, travel spread and locals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.operators.attendance import current_persons
from turnout.operators.attractors import top_ranked
from turnout.operators.boxes import PAIR_BUDGET
from turnout.operators.places import (
    attendance_density,
    known_participants,
    located_events,
    participants_at,
    region_summary,
)
from turnout.operators.regions import REGION_RADIUS_KM, geo_regions
from turnout.operators.spread import (
    MAX_REGIONS,
    MAX_SPREAD_KM,
    POINTS_IN_ROW,
    is_local,
    person_spread,
)
from turnout.sources.tables import Sources

# Fixed value: length of the list of far travellers.
TOP_TRAVELLERS = 10


@dataclass(frozen=True)
class YearMap:
    """Located events of one year and country, their participants of any nationality, and who these are."""

    events: DataFrame
    participants: DataFrame
    persons: DataFrame
    country: str


def year_map(
    sources: Sources, year: int, country: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df
) -> YearMap:
    """The map's tables. ``keep`` may persist what is read more than once, all of it of that year only.

    Records of persons are cut down to the participants, as the reports look up nobody else.
    """
    events = keep(located_events(sources.competitions, year, country))
    pairs = keep(participants_at(sources.results, events))
    persons = keep(current_persons(sources.persons).join(pairs.select("person_id"), "person_id", "left_semi"))
    return YearMap(events, keep(known_participants(pairs, persons)), persons, country)


def density_all(map_: YearMap) -> DataFrame:
    return attendance_density(map_.events, map_.participants)


def regions(
    map_: YearMap, radius_km: float = REGION_RADIUS_KM, pair_budget: int = PAIR_BUDGET
) -> DataFrame:
    return geo_regions(map_.events, radius_km, pair_budget)


def _nationals(map_: YearMap) -> DataFrame:
    """Participants whose current record names the map's country."""
    at_home = map_.persons.where(F.col("person_country") == map_.country)
    return map_.participants.join(at_home, "person_id", "left_semi")


def spread(
    map_: YearMap,
    region_of: DataFrame,
    max_spread_km: float = MAX_SPREAD_KM,
    max_regions: int = MAX_REGIONS,
    points_in_row: int = POINTS_IN_ROW,
    pair_budget: int = PAIR_BUDGET,
) -> DataFrame:
    """Travel of the country's own participants, and who of them is a local."""
    positions = map_.events.select("competition_id", "lat", "lon").join(region_of, "competition_id")
    starts = _nationals(map_).join(positions, "competition_id")
    return person_spread(starts, points_in_row, pair_budget).withColumn("is_local", is_local(max_spread_km, max_regions))


def map_summary(map_: YearMap, travel: DataFrame) -> DataFrame:
    """One row: events, starts and persons on the map, and how many of its own are locals.

    The three counts of one row each are added up over a union, so that nothing has to be crossed.
    """
    starts = map_.participants.groupBy("person_id").agg(F.count(F.lit(1)).alias("starts"))
    parts = [
        map_.events.select(F.lit(1).alias("n_comps")),
        starts.select(F.col("starts").alias("n_starts"), F.lit(1).alias("n_persons")),
        travel.select(F.lit(1).alias("n_own"), F.col("is_local").cast("int").alias("n_locals")),
    ]
    rows = parts[0].unionByName(parts[1], True).unionByName(parts[2], True)
    return rows.agg(
        *[
            F.coalesce(F.sum(name), F.lit(0)).alias(name)
            for name in ("n_comps", "n_starts", "n_persons", "n_own", "n_locals")
        ]
    )


def globetrotters(map_: YearMap, travel: DataFrame, limit: int = TOP_TRAVELLERS) -> DataFrame:
    named = travel.join(map_.persons.select("person_id", "name"), "person_id")
    # To the millimetre, so that equal distances tie whatever order their terms were added in.
    order = [F.desc(F.round("spread_km", 6)), F.asc("person_id")]
    return top_ranked(named, order, limit).select(
        "rank", "name", "n_starts", "n_regions", "spread_km"
    )


def _local_participants(map_: YearMap, travel: DataFrame) -> DataFrame:
    locals_ = travel.where("is_local").select("person_id")
    return map_.participants.join(locals_, "person_id", "left_semi")


def density_locals(map_: YearMap, travel: DataFrame) -> DataFrame:
    return attendance_density(map_.events, _local_participants(map_, travel))


def locals_by_region(map_: YearMap, region_of: DataFrame, travel: DataFrame) -> DataFrame:
    return region_summary(map_.events, region_of, _local_participants(map_, travel))
