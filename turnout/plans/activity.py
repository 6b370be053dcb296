"""How many people take part, how often, and how many are new."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnout.functions.dates import quarter_label
from turnout.functions.numbers import percentage
from turnout.operators.attendance import AttendanceModel
from turnout.operators.histogram import (
    unit_bins,
    value_counts,
    weighted_mean,
    weighted_percentile,
)

# Fixed value: the quarters that make a person consistently active.
ACTIVE_QUARTERS = 3


def _labelled(df: DataFrame, *measures: str) -> DataFrame:
    label = quarter_label(F.col("year"), F.col("quarter")).alias("label")
    return df.select("year", "quarter", label, *measures).orderBy("year", "quarter")


def unique_competitors(model: AttendanceModel) -> DataFrame:
    per_quarter = model.by_person.groupBy("year", "quarter").agg(
        F.count_distinct("person_id").alias("n")
    )
    return _labelled(per_quarter, "n")


def _new_and_returning(model: AttendanceModel) -> DataFrame:
    """Distinct newcomers and distinct returning persons per quarter.

    Who debuts and starts again in one quarter is in both counts. Reducing to one row per person
    and quarter first replaces two distinct counts and an outer join by two plain aggregates.
    """
    per_person = model.by_person.groupBy("year", "quarter", "person_id").agg(
        F.bool_or("is_newcomer").alias("debuts"),
        F.bool_or(~F.col("is_newcomer")).alias("returns"),
    )
    return per_person.groupBy("year", "quarter").agg(
        F.count_if("debuts").alias("newcomers"), F.count_if("returns").alias("returning")
    )


def new_vs_returning(model: AttendanceModel) -> DataFrame:
    return _labelled(_new_and_returning(model), "newcomers", "returning")


def newcomer_share(model: AttendanceModel) -> DataFrame:
    """Newcomers in per cent of newcomers plus returning, and the mean of the quarters' shares.

    The window spans one row per calendar quarter.
    """
    share = percentage(F.col("newcomers"), F.col("newcomers") + F.col("returning"))
    quarters = _new_and_returning(model).select("year", "quarter", share.alias("pct_new"))
    averaged = quarters.withColumn("avg_pct_new", F.avg("pct_new").over(Window.partitionBy()))
    return _labelled(averaged, "pct_new", "avg_pct_new")


def _starts_per_year(model: AttendanceModel) -> DataFrame:
    """(year, starts, persons): how many persons had that many starts in the year."""
    starts = model.by_person.groupBy("person_id", "year").agg(F.sum("n_starts").alias("n_comps"))
    return value_counts(starts, ["year"], "n_comps", "n_persons")


def starts_histogram(model: AttendanceModel, cap: int | None = None) -> DataFrame:
    """Persons by number of starts, per year; the median is over the uncapped numbers.

    Every number of starts has its row. With a ``cap`` the last row holds all from there on.
    """
    binned = unit_bins(_starts_per_year(model), ["year"], "n_comps", "n_persons", 1, cap)
    medians = binned.select("year", F.explode("counts").alias("c")).groupBy("year").agg(
        F.percentile(F.col("c.value"), F.lit(0.5), F.col("c.n")).alias("median_n")
    )
    return (
        binned.select("year", F.explode("bins").alias("item"))
        .join(medians, "year")
        .select(
            "year",
            F.col("item.bin").alias("n_comps"),
            F.col("item.n").alias("n_persons"),
            "median_n",
        )
        .orderBy("year", "n_comps")
    )


def consistently_active(model: AttendanceModel, min_quarters: int = ACTIVE_QUARTERS) -> DataFrame:
    """Persons who took part in at least ``min_quarters`` quarters of a year.

    A person's quarters are four flags, so no distinct aggregate is needed.
    """
    flags = [F.bool_or(F.col("quarter") == q).cast("int") for q in range(1, 5)]
    per_person = model.by_person.groupBy("person_id", "year").agg(
        (flags[0] + flags[1] + flags[2] + flags[3]).alias("quarters_active")
    )
    return (
        per_person.where(F.col("quarters_active") >= min_quarters)
        .groupBy("year")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("year")
    )


def activity_trend(model: AttendanceModel) -> DataFrame:
    """Mean, median and 75th percentile of starts per person and year, all exact."""
    return (
        _starts_per_year(model)
        .groupBy("year")
        .agg(
            weighted_mean("n_comps", "n_persons").alias("mean_n"),
            weighted_percentile("n_comps", 0.5, "n_persons").alias("median_n"),
            weighted_percentile("n_comps", 0.75, "n_persons").alias("q75_n"),
        )
        .orderBy("year")
    )
