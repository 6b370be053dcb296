"""Which events, places and months draw newcomers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnout.functions.numbers import percentage
from turnout.functions.text import EVENT_NAMES, display_name, tokens


def newcomer_counts(attendance: DataFrame) -> DataFrame:
    """Participants, newcomers and their share per event.

    An attendance row is one person at one event, so counting rows counts persons.
    """
    return (
        attendance.groupBy("competition_id")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("is_newcomer").alias("newcomers"),
        )
        .withColumn("pct_newcomers", percentage(F.col("newcomers"), F.col("total")))
    )


def with_event_attributes(counts: DataFrame, competitions: DataFrame) -> DataFrame:
    return counts.join(
        competitions.select(
            "competition_id", "name", "city_name", "year", "month",
            "latitude_microdegrees", "longitude_microdegrees", "event_specs",
        ),
        "competition_id",
    )


def competition_newcomer_stats(competitions: DataFrame, attendance: DataFrame) -> DataFrame:
    """Participants, newcomers and their share per event, with the event's attributes."""
    return with_event_attributes(newcomer_counts(attendance), competitions)


def top_ranked(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows in ``order`` with their ``rank``; the window sees those rows only."""
    return (
        df.orderBy(*order).limit(limit)
        .withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    )


def share_by_list_element(
    stats: DataFrame, list_column: str = "event_specs", names: dict[str, str] = EVENT_NAMES
) -> DataFrame:
    """Mean newcomer share over the events that list an element.

    An element listed twice by an event weighs twice in the mean and once in ``n_comps``. The
    per-event step keeps a common element from gathering its events in one task.
    """
    listed = stats.select(
        "competition_id", "pct_newcomers", F.explode(tokens(F.col(list_column))).alias("event_id")
    )
    per_event = listed.groupBy("event_id", "competition_id").agg(
        F.sum("pct_newcomers").alias("pct_sum"), F.count(F.lit(1)).alias("listings")
    )
    overall = stats.agg(F.avg("pct_newcomers")).scalar()
    # Rounded, as an element every event lists has the overall mean up to the order of its sum.
    reaches_average = F.round("avg_pct", 9) >= F.round("overall_avg", 9)
    return (
        per_event.groupBy("event_id")
        .agg(
            (F.sum("pct_sum") / F.sum("listings")).alias("avg_pct"),
            F.count(F.lit(1)).alias("n_comps"),
        )
        .withColumn("event_name", display_name(F.col("event_id"), names))
        .withColumn("overall_avg", overall)
        .withColumn("band", F.when(reaches_average, "above").otherwise("below"))
    )
