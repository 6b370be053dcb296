"""The whole report as tables: every chart, for all history and for the last years."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.operators.attendance import AttendanceModel
from turnout.operators.periods import first_year_of_last, last_years, period_label, period_suffix
from turnout.operators.returning import returning_newcomers
from turnout.plans import activity, attraction, newcomers, recurring, summary, travel, trends
from turnout.sources import versions
from turnout.sources.sinks import read_table, write_table
from turnout.sources.tables import Sources

Plan = Callable[[AttendanceModel], DataFrame]

# Table name, title, plan; in the order of the charts.
CHARTS: tuple[tuple[str, str, Plan], ...] = (
    ("01_comps_per_quarter", "Events per quarter", trends.competitions_per_quarter),
    ("02_comps_per_month", "Events per month, by year", trends.competitions_per_month),
    ("03_comps_ytd", "Events year to date", trends.competitions_year_to_date),
    ("04_attendance_per_quarter", "Mean and median field size per quarter", trends.attendance_per_quarter),
    ("05_unique_competitors", "Unique participants per quarter", activity.unique_competitors),
    ("06_new_vs_returning", "Newcomers and returning participants", activity.new_vs_returning),
    ("07_newcomer_share", "Share of newcomers per quarter", activity.newcomer_share),
    ("08_starts_histogram", "Starts per person and year", activity.starts_histogram),
    ("09_consistently_active", "Active in three or more quarters", activity.consistently_active),
    ("10_activity_trend", "Mean, median and 75th percentile of starts", activity.activity_trend),
    ("11_debuts_per_quarter", "Debuts per quarter", newcomers.debuts_per_quarter),
    ("12_debuts_per_month", "Debuts per month, by year", newcomers.debuts_per_month),
    ("13_cohort_retention", "Cohort retention, per cent and absolute", newcomers.retention),
    ("15_return_distribution", "Returns per newcomer", newcomers.return_distribution),
    ("16_series_heatmap", "Recurring series by year", recurring.series_heatmap),
    ("17_series_trend", "Attendance of the leading series", recurring.series_trend),
    ("18_top_by_newcomers", "Events with the most newcomers", attraction.top_by_newcomers),
    ("19_top_by_share", "Events with the highest share of newcomers", attraction.top_by_share),
    ("20_city_bubbles", "Newcomers by city", attraction.city_bubbles),
    ("21_by_calendar_month", "Newcomers by calendar month", attraction.by_calendar_month),
    ("22_by_event_offered", "Share of newcomers by discipline offered", attraction.by_event_offered),
)


# Reports that are written as CSV whatever the format of the others.
CSV_TABLES = ("newcomer_cohort_summary", "recurring_series", "returning_newcomers")


# Charts with a year in every row, to which other years add nothing: a period's table is a part of the
# table of all history. Debuts are marked before a period is cut, and the last day is in every period.
YEAR_BY_YEAR = frozenset(
    "01_comps_per_quarter 02_comps_per_month 03_comps_ytd 04_attendance_per_quarter 05_unique_competitors "
    "06_new_vs_returning 08_starts_histogram 09_consistently_active 10_activity_trend 11_debuts_per_quarter "
    "12_debuts_per_month 13_cohort_retention".split()
)
IN_ORDER = ("year", "quarter", "month", "n_comps")


def without_first_event(model: AttendanceModel) -> AttendanceModel:
    """The model without the first event of each attendance, which no chart reads and which costs joins."""
    return replace(model, attendance=model.attendance.drop("first_comp_date"))


def write_bundle(
    model: AttendanceModel,
    directory: str,
    periods: Sequence[int | None] = summary.PERIODS,
    charts: Sequence[tuple[str, str, Plan]] = CHARTS,
    format: str = "parquet",
) -> list[tuple[str, str]]:
    """Write one table per chart and period as ``<directory>/<chart><period suffix>``.

    The model, and one row per event with its newcomers, are computed once and kept on the executors
    while the tables are written, unless the caller keeps them already. A chart whose rows belong to a
    year each is computed once too: the tables of shorter periods are read off that of all history,
    if it is among the periods. Returns the path and title of every table, with the period's label
    table first.
    """
    kept = []
    if not model.attendance.is_cached:
        model = without_first_event(model)
        kept = [model.competitions, model.attendance]
    if model.event_stats is None:
        model = replace(model, event_stats=attraction.competition_stats(model))
        kept.append(model.event_stats)
    for df in kept:
        df.persist(StorageLevel.MEMORY_AND_DISK)
    whole: dict[str, DataFrame] = {}
    try:
        written = {}
        for years in sorted(periods, key=lambda n: n is not None):
            part, suffix = last_years(model, years), period_suffix(years)
            path = f"{directory}/00_period{suffix}"
            written[years] = [(write_table(period_label(part.competitions), path, format), "Period")]
            for name, title, plan in charts:
                if name in whole:
                    table = whole[name].where(F.col("year") >= first_year_of_last(model.competitions, years))
                    table = table.orderBy(*(c for c in IN_ORDER if c in table.columns))
                else:
                    table = plan(part)
                path = write_table(table, f"{directory}/{name}{suffix}", format)
                written[years].append((path, title))
                if years is None and name in YEAR_BY_YEAR:
                    whole[name] = read_table(table.sparkSession, path, table.schema, format)
        path = write_table(summary.period_summary(model, periods), f"{directory}/period_summary", format)
        tables = [table for years in periods for table in written[years]]
        return [*tables, (path, "Events, attendance and persons per period")]
    finally:
        for df in kept:
            df.unpersist()


def publish_bundle(
    spark: SparkSession,
    directory: str,
    write: Callable[[str], Sequence[tuple[str, str]]],
    format: str = "parquet",
    keep: int = 2,
) -> versions.Version:
    """Write a set of report tables and make all of them current at once.

    ``write`` gets a folder of its own and returns the path and title of every table below it, as the
    writers of this module do. The manifest that names the tables comes last, so readers see the bundle
    before or the whole new one, also if the run fails between two tables. ``keep`` versions stay; what
    readers of older ones have open goes.
    """
    before = versions.current(spark, directory)
    folder = versions.new_folder()
    tables = {}
    for path, title in write(f"{directory}/{folder}"):
        name = path.rsplit("/", 1)[1]
        kind = "csv" if name.startswith(CSV_TABLES) else format
        options = versions.CSV_OPTIONS if kind == "csv" else {}
        schema = spark.read.options(**options).format(kind).load(path).schema
        tables[name] = versions.Table(schema, {"": (f"{folder}/{path.rsplit(folder + '/', 1)[1]}",)}, kind, title)
    number = 1 if before is None else before.number + 1
    version = versions.publish(spark, directory, versions.Version(number, tables))
    versions.forget(spark, directory, keep)
    return version


def read_bundle(spark: SparkSession, directory: str, name: str, number: int | None = None) -> DataFrame:
    """A table of the current bundle, or of a kept version of it."""
    return versions.read(spark, directory, name, number)


def write_year_map(map_: travel.YearMap, directory: str, format: str = "parquet") -> list[tuple[str, str]]:
    """Write the tables of a year's map; regions and travel spread are computed once."""
    kept = [df.persist(StorageLevel.MEMORY_AND_DISK) for df in (map_.events, map_.persons, map_.participants)]
    try:
        region_of = travel.regions(map_).persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(region_of)
        trips = travel.spread(map_, region_of).persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(trips)
        tables = (
            ("map_density_all", "Persons per place", travel.density_all(map_)),
            ("map_density_locals", "Locals per place", travel.density_locals(map_, trips)),
            ("map_regions", "Region of every event", region_of),
            ("map_person_spread", "Travel spread per person", trips),
            ("map_globetrotters", "Farthest travellers", travel.globetrotters(map_, trips)),
            ("map_region_summary", "Locals per region", travel.locals_by_region(map_, region_of, trips)),
            ("map_summary", "Events, starts, persons and locals", travel.map_summary(map_, trips)),
        )
        return [(write_table(df, f"{directory}/{name}", format), title) for name, title, df in tables]
    finally:
        for df in kept:
            df.unpersist()


def write_cohort_summary(model: AttendanceModel, directory: str, years: int | None = None) -> str:
    """The cohort table as CSV with a header."""
    rows = newcomers.retention(last_years(model, years))
    return write_table(rows, f"{directory}/newcomer_cohort_summary{period_suffix(years)}", "csv")


def write_series_matrix(model: AttendanceModel, directory: str, years: int | None = None) -> str:
    """The series by year matrix as CSV with a header."""
    rows = recurring.series_wide(last_years(model, years))
    return write_table(rows, f"{directory}/recurring_series{period_suffix(years)}", "csv")


def write_returning_newcomers(sources: Sources, directory: str, year: int, country: str) -> str:
    """The returning-newcomers report as CSV with a header."""
    rows = returning_newcomers(sources.competitions, sources.results, year, country)
    return write_table(rows, f"{directory}/returning_newcomers_{year}", "csv")
