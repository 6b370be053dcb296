"""Debuts, follow-ups, cohort retention and return counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnout.functions.dates import days_between, quarter_label, quarter_of
from turnout.functions.numbers import percentage_one_decimal
from turnout.operators.attendance import with_person_columns

# Retention windows in days, both ends included.
RETENTION_WINDOWS = {"3m": 90, "6m": 180, "12m": 365}


def debuts(attendance: DataFrame) -> DataFrame:
    """One row per newcomer. Several events on the debut day share its date, so one remains."""
    return (
        attendance.where("is_newcomer")
        .groupBy("person_id")
        .agg(F.min("date").alias("debut_date"))
        .withColumn("debut_year", F.year("debut_date"))
        .withColumn("debut_month", F.month("debut_date"))
        .withColumn("debut_quarter", quarter_of(F.col("debut_month")))
    )


def followups(attendance: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Every attendance of the newcomers with the days since their debut; the debut is day 0.

    ``days`` are the stored days of the persons, if the model has them.
    """
    rows = attendance.select("person_id", "competition_id", "date")
    newcomers = debuts(attendance if days is None else days)
    return with_person_columns(rows, newcomers, days=days).withColumn(
        "days_after", days_between(F.col("date"), F.col("debut_date"))
    )


def _histories(days: DataFrame) -> DataFrame:
    """One row per person: debut in these rows (null if none), first return, returns, last date.

    A newcomer's rows are either on the debut day, and then marked as newcomer, or later. So
    retention needs no join of debuts to follow-ups: one aggregate per person, pre-aggregated in
    every task. Who first returns after d days has returned within every window of d days or more.
    Days of persons count ``n_starts`` times, attendance rows once.
    """
    starts = F.col("n_starts") if "n_starts" in days.columns else F.lit(1).cast("long")
    returns = F.sum(F.when(~F.col("is_newcomer"), starts))
    return (
        days.groupBy("person_id")
        .agg(
            F.min(F.when(F.col("is_newcomer"), F.col("date"))).alias("debut_date"),
            F.min(F.when(~F.col("is_newcomer"), F.col("date"))).alias("return_date"),
            F.coalesce(returns, F.lit(0).cast("long")).alias("returns"),
            F.max("date").alias("last_date"),
        )
        .withColumn("days_to_return", days_between(F.col("return_date"), F.col("debut_date")))
    )


def newcomer_histories(attendance: DataFrame) -> DataFrame:
    """One row per newcomer: debut, days to the first return (null if none), number of returns."""
    newcomers = _histories(attendance).where(F.col("debut_date").isNotNull())
    return newcomers.select("person_id", "debut_date", "days_to_return", "returns")


def cohort_retention(
    attendance: DataFrame, windows: Mapping[str, int] = RETENTION_WINDOWS
) -> DataFrame:
    """Per debut quarter: newcomers, and how many returned within each window of days.

    ``complete_<window>`` tells whether the data reach as far as the window of the quarter's last day;
    until then its numbers can still rise.
    """
    cohort = (
        _histories(attendance)
        .groupBy(
            F.year("debut_date").alias("year"),
            quarter_of(F.month("debut_date")).alias("quarter"),
        )
        .agg(
            F.count("debut_date").alias("newcomers"),
            F.max("last_date").alias("last_date"),
            *[
                F.count_if(F.col("days_to_return") <= days).alias(f"ret_{key}")
                for key, days in windows.items()
            ],
        )
    )
    # One row per quarter, and one for everybody who is no newcomer, whose last day counts too.
    last_day = F.max("last_date").over(Window.partitionBy())
    cohort = cohort.withColumn("last_day", last_day).where(F.col("year").isNotNull())
    measures = []
    for key in windows:
        returned = F.col(f"ret_{key}")
        measures += [
            returned,
            percentage_one_decimal(returned, F.col("newcomers")).alias(f"pct_{key}"),
        ]
    quarter_end = F.last_day(F.make_date("year", F.col("quarter") * 3, F.lit(1)))
    measures += [
        (F.date_add(quarter_end, days) <= F.col("last_day")).alias(f"complete_{key}")
        for key, days in windows.items()
    ]
    return cohort.select(
        "year",
        "quarter",
        quarter_label(F.col("year"), F.col("quarter")).alias("label"),
        "newcomers",
        *measures,
    )


def return_counts(attendance: DataFrame) -> DataFrame:
    """Later events per newcomer, zero for those who never came back."""
    return newcomer_histories(attendance).select("person_id", "returns")
