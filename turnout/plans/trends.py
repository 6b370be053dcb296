"""Event counts and field sizes over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.functions.dates import quarter_label, quarter_of
from turnout.operators.attendance import AttendanceModel
from turnout.operators.dense import dense_month_counts, ytd_running_total
from turnout.operators.histogram import value_counts, weighted_mean, weighted_percentile


def field_sizes(model: AttendanceModel) -> DataFrame | None:
    """(competition_id, n_competitors) of events with participants, if the model brings its events' sizes or stats along."""
    if model.event_sizes is not None:
        return model.event_sizes
    if model.event_stats is None:
        return None
    return model.event_stats.select("competition_id", F.col("total").alias("n_competitors"))


def competitions_per_quarter(model: AttendanceModel) -> DataFrame:
    return (
        model.competitions.groupBy("year", "quarter")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("year", "quarter", quarter_label(F.col("year"), F.col("quarter")).alias("label"), "n")
        .orderBy("year", "quarter")
    )


def competitions_per_month(model: AttendanceModel) -> DataFrame:
    return dense_month_counts(model.competitions)


def competitions_year_to_date(model: AttendanceModel) -> DataFrame:
    return ytd_running_total(dense_month_counts(model.competitions))


def attendance_per_quarter(model: AttendanceModel) -> DataFrame:
    """Mean and exact median field size; events nobody attended are not counted.

    Field sizes are reduced to (quarter, size, how often) before the median, so its state stays
    as small as the number of different sizes.
    """
    if model.event_stats is not None:
        sizes = model.event_stats.select("year", quarter_of(F.col("month")).alias("quarter"), F.col("total").alias("n_competitors"))
    else:
        sizes = model.attendance.groupBy("competition_id", "year", "quarter").agg(
            F.count(F.lit(1)).alias("n_competitors")
        )
    return (
        value_counts(sizes, ["year", "quarter"], "n_competitors")
        .groupBy("year", "quarter")
        .agg(
            weighted_mean("n_competitors", "n_rows").alias("mean_n"),
            weighted_percentile("n_competitors", 0.5, "n_rows").alias("median_n"),
        )
        .select(
            "year", "quarter", quarter_label(F.col("year"), F.col("quarter")).alias("label"),
            "mean_n", "median_n",
        )
        .orderBy("year", "quarter")
    )
