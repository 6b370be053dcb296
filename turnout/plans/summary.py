"""Section statistics: the extent of the data in each period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.operators.attendance import AttendanceModel
from turnout.operators.periods import first_year_of_last, period_suffix

# All history and the last five years.
PERIODS = (None, 5)


def period_summary(
    model: AttendanceModel, periods: Sequence[int | None] = PERIODS
) -> DataFrame:
    """Years, events, attendance rows and distinct persons per period, in one pass.

    Attendance is first reduced to one row per person and year; each row then counts for every
    period its year lies in.
    """
    events = model.competitions.groupBy("year").agg(F.count(F.lit(1)).alias("n_comps"))
    starts = model.attendance.groupBy("year", "person_id").agg(F.count(F.lit(1)).alias("n_att"))
    rows = events.unionByName(starts, allowMissingColumns=True)

    def label(years: int | None):
        name = F.lit(period_suffix(years).lstrip("_"))
        if years is None:
            return name
        return F.when(F.col("year") >= first_year_of_last(model.competitions, years), name)

    member_of = F.array_compact(F.array(*[label(years) for years in periods]))
    event_year = F.when(F.col("n_comps").isNotNull(), F.col("year"))
    return (
        rows.withColumn("period", F.explode(member_of))
        .groupBy("period")
        .agg(
            F.min(event_year).alias("yr_min"),
            F.max(event_year).alias("yr_max"),
            F.coalesce(F.sum("n_comps"), F.lit(0)).alias("n_comps"),
            F.coalesce(F.sum("n_att"), F.lit(0)).alias("n_att"),
            F.count_distinct("person_id").alias("n_persons"),
        )
    )
