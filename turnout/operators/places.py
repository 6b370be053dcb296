"""Located events of one year, who attended them, and attendance per place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnout.functions.geodesy import degrees_from_micro
from turnout.operators.attendance import held_in, participations


def located_events(competitions: DataFrame, year: int, country: str) -> DataFrame:
    """Events of the country and year that took place at a known position."""
    return (
        held_in(competitions, country)
        .where(
            (F.col("year") == year)
            & F.col("latitude_microdegrees").isNotNull()
            & F.col("longitude_microdegrees").isNotNull()
        )
        .select(
            F.col("id").alias("competition_id"),
            "cell_name",
            "city_name",
            degrees_from_micro(F.col("latitude_microdegrees")).alias("lat"),
            degrees_from_micro(F.col("longitude_microdegrees")).alias("lon"),
        )
    )


def participants_at(results: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct (event, person) pairs of the events.

    One year's events are few, so results are cut down to them before they are shuffled.
    """
    return participations(results.join(events, "competition_id", "left_semi"))


def known_participants(pairs: DataFrame, persons: DataFrame) -> DataFrame:
    """The pairs whose person has a current record."""
    return pairs.join(persons, "person_id", "left_semi")


def attendance_density(events: DataFrame, participants: DataFrame) -> DataFrame:
    """Persons per event place; events without a cell name are left out.

    Pairs are distinct, so rows are counted per event before the attributes are joined on.
    """
    counts = participants.groupBy("competition_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        events.where(F.col("cell_name").isNotNull())
        .join(counts, "competition_id")
        .select(
            "competition_id", "cell_name", "lat", "lon", "n",
            F.concat_ws(": ", "cell_name", F.col("n").cast("string")).alias("popup"),
        )
    )


def region_summary(events: DataFrame, regions: DataFrame, participants: DataFrame) -> DataFrame:
    """Distinct persons per region and the mean position of all the region's events, most persons first.

    The rank is numbered over one row per region, of which the globe's surface bounds the number.
    """
    visitors = (
        participants.join(regions, "competition_id")
        .select("region", "person_id")
        .distinct()
        .groupBy("region")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    centres = (
        events.join(regions, "competition_id")
        .groupBy("region")
        .agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    )
    order = [F.desc("n"), F.asc("region")]
    return (
        visitors.join(centres, "region")
        .withColumn("rank", F.row_number().over(Window.orderBy(*order)))
        .select("rank", "region", "n", "lat", "lon")
        .orderBy("rank")
    )
