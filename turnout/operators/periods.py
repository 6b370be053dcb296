"""Restricting a model to its last years, and naming the period."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.operators.attendance import AttendanceModel


def first_year_of_last(competitions: DataFrame, years: int) -> Column:
    """First calendar year of the last ``years`` years of the data, as a scalar subquery."""
    if isinstance(years, bool) or not isinstance(years, int) or years < 1:
        raise ValueError(f"number of years must be a positive integer, got {years!r}")
    return competitions.agg(F.max("year")).scalar() - F.lit(years - 1)


def last_years(model: AttendanceModel, years: int | None) -> AttendanceModel:
    """The model over its last ``years`` years; ``None`` keeps all history.

    Runs after debut marking: ``first_comp_date`` still comes from all history, so nobody becomes
    a newcomer by the cut. An attendance row carries its event's year, so it is cut by the same
    comparison and needs no join back to the events.
    """
    if years is None:
        return model
    recent = F.col("year") >= first_year_of_last(model.competitions, years)
    return replace(
        model,
        competitions=model.competitions.where(recent),
        attendance=model.attendance.where(recent),
        event_stats=None if model.event_stats is None else model.event_stats.where(recent),
        person_days=None if model.person_days is None else model.person_days.where(recent),
    )


def period_suffix(years: int | None) -> str:
    """``_all`` or ``_last5y``, for output names."""
    return "_all" if years is None else f"_last{years}y"


def period_label(competitions: DataFrame) -> DataFrame:
    """One row: first and last year and their label."""
    return competitions.agg(
        F.min("year").alias("yr_min"), F.max("year").alias("yr_max")
    ).withColumn("period_label", F.concat_ws("–", "yr_min", "yr_max"))
