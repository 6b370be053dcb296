"""Exact distinct persons over any span of quarters, from bitmaps instead of attendance rows.

Persons get dense numbers, and every quarter a bitmap of the numbers that took part. A span's persons
are the bits of its quarters' bitmaps together, so a new span reads some kilobytes per quarter and
32,768 persons, and never the attendance again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnout.functions.dates import quarter_label
from turnout.operators.lineage import cut

QUARTER = ["year", "quarter"]
# Bits below those of the partition in the ids that Spark gives to rows.
ROW_BITS = 33


def number_persons(persons: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(person_id, number): dense numbers from 1 for the distinct ``person_id``, which are not null.

    Numbers of ``known`` stay, and persons it lacks follow after them. Every partition counts its own
    rows, and a window over one row per partition says where each begins.
    """
    names = persons.select("person_id").where(F.col("person_id").isNotNull()).distinct()
    start = 1
    if known is not None:
        names = names.join(known.select("person_id"), "person_id", "left_anti")
        start += known.agg(F.max("number")).first()[0] or 0
    placed = cut(names.withColumn("at", F.monotonically_increasing_id()))
    placed = placed.select("person_id", F.shiftright("at", ROW_BITS).alias("part"), F.col("at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("at"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbers = placed.join(firsts, "part").select("person_id", (F.col("first") + F.col("at") + start).alias("number"))
    return numbers if known is None else known.select("person_id", "number").unionByName(numbers)


def quarter_bitmaps(attendance: DataFrame, numbers: DataFrame) -> DataFrame:
    """(year, quarter, bucket, persons): which numbers took part, 32,768 in a bitmap.

    Attendance is reduced to one row per person and quarter first. A person has at most as many of
    these as there are quarters, so neither the join nor a bucket is hot. Tasks make bitmaps of their
    own rows before the shuffle, so what is sent per quarter and bucket is bitmaps, however many rows
    a bucket has.
    """
    active = attendance.select("person_id", *QUARTER).distinct().join(numbers, "person_id")
    return active.groupBy(*QUARTER, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("persons")
    )


def add_bitmaps(rollup: DataFrame, more: DataFrame) -> DataFrame:
    """Two rollups over the same numbers as one, such as history and a new batch of attendance."""
    return rollup.unionByName(more).groupBy(*QUARTER, "bucket").agg(F.bitmap_or_agg("persons").alias("persons"))


def persons_by_span(rollup: DataFrame, spans: Column) -> DataFrame:
    """(span, n_persons) with ``spans``, an array of the spans that a quarter belongs to.

    Bitmaps of a span are united bucket by bucket and then counted, both with partial results first.
    """
    united = (
        rollup.select("bucket", "persons", F.explode(spans).alias("span"))
        .groupBy("span", "bucket")
        .agg(F.bitmap_or_agg("persons").alias("persons"))
    )
    return united.groupBy("span").agg(F.sum(F.bitmap_count("persons")).alias("n_persons"))


def _nth(year: Column, quarter: Column) -> Column:
    return (year * 4 + quarter - 1).cast("int")


def persons_over_quarters(rollup: DataFrame, quarters: int = 4) -> DataFrame:
    """Persons of the ``quarters`` quarters that end with each one, up to the last quarter of the data."""
    if quarters < 1:
        raise ValueError(f"number of quarters must be positive, got {quarters!r}")
    nth = _nth(F.col("year"), F.col("quarter"))
    last = rollup.agg(F.max(nth)).scalar()
    counted = persons_by_span(rollup, F.sequence(nth, F.least(nth + (quarters - 1), last)))
    year, quarter = F.floor(F.col("span") / 4).cast("int"), (F.col("span") % 4 + 1).cast("int")
    return counted.select(year.alias("year"), quarter.alias("quarter"), quarter_label(year, quarter).alias("label"), "n_persons")


def persons_per_year(rollup: DataFrame) -> DataFrame:
    return persons_by_span(rollup, F.array("year")).withColumnRenamed("span", "year")


def persons_to_date(rollup: DataFrame) -> DataFrame:
    """Persons from the beginning to the end of each year, up to the last year of the data."""
    last = rollup.agg(F.max("year")).scalar()
    return persons_by_span(rollup, F.sequence("year", last)).withColumnRenamed("span", "year")


def persons_between(rollup: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """One row, ``n_persons`` of the span from quarter ``first`` to ``last``, both (year, quarter)."""
    nth = _nth(F.col("year"), F.col("quarter"))
    ends = [year * 4 + quarter - 1 for year, quarter in (first, last)]
    united = rollup.where(nth.between(*ends)).groupBy("bucket").agg(F.bitmap_or_agg("persons").alias("persons"))
    return united.agg(F.coalesce(F.sum(F.bitmap_count("persons")), F.lit(0)).alias("n_persons"))
