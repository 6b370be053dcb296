"""Newcomers of a year's events and how many of them ever came back."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.operators.attendance import participations


def returning_newcomers(
    competitions: DataFrame, results: DataFrame, year: int, country: str, pairs: DataFrame | None = None
) -> DataFrame:
    """Per event that ended in ``year``: newcomers, and those with more than one event ever.

    Cancelled events are candidates too, every country counts for a return, and an event without
    newcomers stays with zeros. One plan for all events: the person aggregate is computed once.
    ``pairs``, if the caller has them, are the ``participations`` of ``results``, which are not read then.
    """
    if "end_date" not in competitions.columns:
        raise ValueError("the returning-newcomers report needs a column 'end_date'")
    dated = competitions.select("id", "name", "country_id", "start_date", "end_date")
    ends_in_year = F.col("end_date").between(
        datetime.date(year, 1, 1), datetime.date(year, 12, 31)
    )
    candidates = dated.where((F.col("country_id") == country) & ends_in_year)
    pairs = participations(results) if pairs is None else pairs
    careers = (
        pairs.join(
            dated.select(F.col("id").alias("competition_id"), "start_date"), "competition_id", "left"
        )
        .groupBy("person_id")
        .agg(F.min("start_date").alias("first_date"), F.count(F.lit(1)).alias("n_events"))
    )
    at_candidates = pairs.join(
        candidates.select(F.col("id").alias("competition_id"), "start_date"), "competition_id"
    )
    newcomers = (
        at_candidates.join(careers, "person_id")
        .where(F.col("start_date") == F.col("first_date"))
        .groupBy("competition_id")
        .agg(
            F.count(F.lit(1)).alias("newcomers"),
            F.count_if(F.col("n_events") > 1).alias("returned_newcomers"),
        )
    )
    return (
        candidates.select(F.col("id").alias("competition_id"), F.col("name").alias("competition_name"))
        .join(newcomers, "competition_id", "left")
        .na.fill(0, ["newcomers", "returned_newcomers"])
    )
