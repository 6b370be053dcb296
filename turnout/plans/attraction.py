"""What draws newcomers: events, cities, months, and what an event offers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.functions.geodesy import degrees_from_micro
from turnout.operators.attendance import AttendanceModel
from turnout.operators.attractors import (
    competition_newcomer_stats,
    share_by_list_element,
    top_ranked,
)

# Length of the top lists, smallest field for shares, bubble area per newcomer.
TOP_N = 20
MIN_COMPETITORS = 30
BUBBLE_SCALE = 2.5


def competition_stats(model: AttendanceModel) -> DataFrame:
    """Participants and newcomers per event; those that the model brings along, if it does."""
    if model.event_stats is not None:
        return model.event_stats
    return competition_newcomer_stats(model.competitions, model.attendance)


def top_by_newcomers(model: AttendanceModel, limit: int = TOP_N) -> DataFrame:
    order = [F.desc("newcomers"), F.asc("competition_id")]
    return top_ranked(competition_stats(model), order, limit).select(
        "rank", "competition_id", "name", "year", "newcomers"
    )


def top_by_share(
    model: AttendanceModel, limit: int = TOP_N, min_competitors: int = MIN_COMPETITORS
) -> DataFrame:
    order = [F.desc("pct_newcomers"), F.asc("competition_id")]
    large = competition_stats(model).where(F.col("total") >= min_competitors)
    return top_ranked(large, order, limit).select(
        "rank", "competition_id", "name", "year", "total", "pct_newcomers"
    )


def city_bubbles(model: AttendanceModel, labelled: int = TOP_N) -> DataFrame:
    """Newcomers per city with its mean position; the leading cities carry a label."""
    cities = (
        competition_stats(model)
        .where(F.col("city_name").isNotNull())
        .groupBy("city_name")
        .agg(
            F.sum("newcomers").alias("total_newcomers"),
            F.avg("newcomers").alias("avg_newcomers"),
            F.count(F.lit(1)).alias("n_comps"),
            F.avg(degrees_from_micro(F.col("latitude_microdegrees"))).alias("lat"),
            F.avg(degrees_from_micro(F.col("longitude_microdegrees"))).alias("lon"),
        )
    )
    leading = (
        cities.orderBy(F.desc("total_newcomers"), "city_name")
        .limit(labelled)
        .select("city_name", F.lit(True).alias("is_labelled"))
    )
    return (
        cities.join(leading, "city_name", "left")
        .withColumn("is_labelled", F.coalesce("is_labelled", F.lit(False)))
        .withColumn("bubble_size", F.col("total_newcomers") * BUBBLE_SCALE)
    )


def by_calendar_month(model: AttendanceModel) -> DataFrame:
    """Mean newcomers and mean newcomer share of the events of each calendar month."""
    return (
        competition_stats(model)
        .groupBy("month")
        .agg(F.avg("newcomers").alias("avg_count"), F.avg("pct_newcomers").alias("avg_pct"))
        .orderBy("month")
    )


def by_event_offered(model: AttendanceModel) -> DataFrame:
    """Mean newcomer share of the events that offer a discipline, against the overall mean."""
    return (
        share_by_list_element(competition_stats(model))
        .select("event_id", "event_name", "avg_pct", "n_comps", "overall_avg", "band")
        .orderBy("avg_pct", "event_id")
    )
