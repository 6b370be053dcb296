"""Hand-made source tables."""

from __future__ import annotations

import datetime

from pyspark.sql import SparkSession

from turnout.sources.tables import COMPETITIONS, PERSONS, RESULTS, Sources

HOME = "Home"


def competition(
    id, date, name=None, country=HOME, cancelled=0, city="Town", cell="Cell", lat=None, lon=None,
    specs=None, end=None,
):
    day = datetime.date.fromisoformat(date)
    return (
        id, name or f"Open {id}", cell, city, country, day.year, day.month, day.day, day,
        datetime.date.fromisoformat(end) if end else day, cancelled,
        None if lat is None else round(lat * 1e6), None if lon is None else round(lon * 1e6), specs,
    )


def sources(spark: SparkSession, competitions, results, persons=None) -> Sources:
    """``results`` are (competition, person) pairs; persons default to the ones in the results."""
    if persons is None:
        persons = [(p, 1, f"Name {p}", HOME) for p in sorted({p for _, p in results})]
    return Sources(
        spark.createDataFrame(competitions, COMPETITIONS),
        spark.createDataFrame([(c, p, HOME) for c, p in results], RESULTS),
        spark.createDataFrame(persons, PERSONS),
    )


def rows(df, *columns):
    """Sorted tuples of the given columns."""
    columns = columns or df.columns
    return sorted(
        (tuple(row) for row in df.select(*columns).collect()),
        key=lambda row: tuple((value is None, str(value)) for value in row),
    )
