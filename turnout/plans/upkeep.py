"""Keeping data current: batches that arrive out of order, rows that do not conform, rollups of persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.operators import person_bitmaps
from turnout.operators.attendance import AttendanceModel
from turnout.sources.tables import Sources


def dealt(df: DataFrame, n: int, *keys: str) -> list[DataFrame]:
    """The rows dealt out to ``n`` batches by a checksum of their keys."""
    batch = F.crc32(F.concat_ws("/", *keys).cast("binary")) % n
    return [df.where(batch == k) for k in range(n)]


def late_batches(sources: Sources, n: int = 3) -> list[Sources]:
    """The sources dealt out to ``n`` batches by checksums of their keys, with no regard to time.

    Results come before, with and after their events, and debuts are found too late, as in real life.
    """
    return [
        Sources(*tables)
        for tables in zip(
            dealt(sources.competitions, n, "id"),
            dealt(sources.results, n, "competition_id", "person_id"),
            dealt(sources.persons, n, "person_id"),
        )
    ]


def _spoiled(column: str, faults: list[tuple[Column, str | None]]) -> Column:
    """The column as text, with other values where a fault was planted."""
    text = F.col(column).cast("string")
    for where, value in faults:
        text = F.when(where, F.lit(value)).otherwise(text)
    return text.alias(column)


def faulty_text(sources: Sources) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables as text, with planted faults that follow from the numbers in their keys."""
    event = F.split(F.col("id"), "-")
    n = event[0].cast("long") * 31 + event[1].cast("long")
    events = {
        "month": [(n % 41 == 0, "13")],
        "day": [(n % 43 == 0, "31st")],
        "cancelled": [(n % 47 == 0, "no")],
        "latitude_microdegrees": [(n % 53 == 0, "north")],
        "id": [(n % 59 == 0, "")],
    }
    person = F.substring_index(F.substr(F.col("person_id"), F.lit(2)), "-", 1).cast("long")
    results = {"person_id": [(person % 61 == 0, None)], "competition_id": [(person % 67 == 0, "")]}
    persons = {"sub_id": [(person % 71 == 0, "x1")], "person_id": [(person % 73 == 0, None)]}

    def spoiled(df: DataFrame, faults: dict) -> DataFrame:
        return df.select(*(_spoiled(c, faults.get(c, [])) for c in df.columns))

    return spoiled(sources.competitions, events), spoiled(sources.results, results), spoiled(sources.persons, persons)


def rollup_of(model: AttendanceModel) -> DataFrame:
    """Bitmaps of all persons of the model's attendance, per quarter."""
    numbers = person_bitmaps.number_persons(model.attendance)
    return person_bitmaps.quarter_bitmaps(model.attendance, numbers)


def spans_of_persons(rollup: DataFrame) -> DataFrame:
    """(kind, year, quarter, n_persons): the last four quarters at each one, each year, and all up to each year."""
    columns = ("kind", "year", "quarter", "n_persons")
    rolling = person_bitmaps.persons_over_quarters(rollup).withColumn("kind", F.lit("last 4 quarters"))
    years = person_bitmaps.persons_per_year(rollup).withColumn("kind", F.lit("year"))
    so_far = person_bitmaps.persons_to_date(rollup).withColumn("kind", F.lit("to date"))
    no_quarter = F.lit(None).cast("int")
    return (
        rolling.select(*columns)
        .unionByName(years.withColumn("quarter", no_quarter).select(*columns))
        .unionByName(so_far.withColumn("quarter", no_quarter).select(*columns))
    )
