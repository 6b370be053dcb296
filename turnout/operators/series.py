"""Recurring event series: the same name, years apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnout.functions.text import MONTH_ABBREVIATIONS, series_name, with_month


def event_sizes(attendance: DataFrame) -> DataFrame:
    """(competition_id, n_competitors) of events with participants."""
    return attendance.groupBy("competition_id").agg(F.count(F.lit(1)).alias("n_competitors"))


def recurring_series(
    competitions: DataFrame,
    attendance: DataFrame,
    min_years: int = 3,
    month_names: Sequence[str] = MONTH_ABBREVIATIONS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """One row per series held in at least ``min_years`` different years.

    series, label (with its typical month), editions, total, and ``yearly``: a map from each year
    of the series to its participants. ``editions`` counts the years somebody took part in. An
    event nobody attended counts as zero and still makes its year a year of the series.

    Events are first summed per series, year and month, so a series contributes at most twelve
    rows a year to its own row, however many events it has. ``sizes`` (competition_id, n_competitors) are
    counted from the attendance unless the caller has them.
    """
    if sizes is None:
        sizes = event_sizes(attendance)
    monthly = (
        competitions.select(
            "competition_id", "year", "month", series_name(F.col("name")).alias("series")
        )
        .where(F.col("series").isNotNull())
        .join(sizes, "competition_id", "left")
        .groupBy("series", "year", "month")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.coalesce(F.sum("n_competitors"), F.lit(0)).alias("n"),
        )
    )
    months = monthly.groupBy("series").agg(
        F.collect_list(F.struct("year", "n")).alias("months"),
        F.percentile(F.col("month"), F.lit(0.5), F.col("n_events")).alias("median_month"),
    )
    yearly = F.map_from_entries(
        F.transform(
            F.array_sort(F.array_distinct(F.col("months.year"))),
            lambda year: F.struct(year, _total(F.filter("months", lambda m: m["year"] == year)["n"])),
        )
    )
    totals = F.map_values("yearly")
    typical_month = F.bround("median_month").cast("int")
    return (
        months.select("series", yearly.alias("yearly"), typical_month.alias("typical_month"))
        .where(F.size("yearly") >= min_years)
        .select(
            "series",
            with_month(F.col("series"), F.col("typical_month"), month_names).alias("label"),
            F.size(F.filter(totals, lambda n: n > 0)).cast("bigint").alias("editions"),
            _total(totals).alias("total"),
            "yearly",
        )
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda total, n: total + n)


def series_years(series: DataFrame) -> DataFrame:
    """One row: the sorted array of all years in which any of the series was held."""
    return series.select(F.explode(F.map_keys("yearly")).alias("year")).agg(
        F.sort_array(F.collect_set("year")).alias("years")
    )


def _in_order() -> list[Column]:
    return [F.desc("editions"), F.desc("total"), F.asc("series")]


def top_series(series: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` series by editions, then total, then name, with their ``rank``.

    The limit comes first, so the ranking window sees ``limit`` rows only.
    """
    best = series.orderBy(*_in_order()).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*_in_order())))


def _participants(year: Column) -> Column:
    return F.coalesce(F.try_element_at("yearly", year), F.lit(0))


def dense_years(series: DataFrame, years: DataFrame) -> DataFrame:
    """A row for each series and each of ``years``, zero where the series was not held."""
    return series.withColumn("year", F.explode(years.scalar())).withColumn(
        "n_competitors", _participants(F.col("year"))
    )


def held_years(series: DataFrame) -> DataFrame:
    """A row for each series and year with participants."""
    columns = [c for c in series.columns if c != "yearly"]
    return series.select(*columns, F.explode("yearly").alias("year", "n_competitors")).where(
        F.col("n_competitors") > 0
    )


def series_matrix(series: DataFrame, years: Sequence[int]) -> DataFrame:
    """Wide form: one row per series label in ranking order, one column per given year."""
    return series.orderBy(*_in_order()).select(
        F.col("label").alias("series"),
        *[_participants(F.lit(year)).alias(str(year)) for year in years],
    )
