"""Every named query over a star-schema directory, as ``(spark, directory) -> DataFrame``."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnout.operators.cohorts import debuts, followups, return_counts
from turnout.operators.periods import last_years
from turnout.operators.returning import returning_newcomers
from turnout.plans import activity, attraction, newcomers, recurring, summary, travel, trends, upkeep
from turnout.plans.workspace import Workspace
from turnout.session import configure
from turnout.sources.quarantine import rejection_report
from turnout.sources.star_schema import star_schema_sources

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries. The fields of the star schema are small, so a share is
# taken from 10 participants on; the library's own default is 30.
COUNTRY = "AMERICA"
MAP_YEAR = 1998
RETURN_YEAR = 1998
SMALL_FIELD = 10


_open: dict[tuple[str, str], Workspace] = {}


def _folder_for_tests(spark: SparkSession) -> None:
    """A local session without a checkpoint folder gets one; a cluster has to name its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="turnout-", dir="/tmp"))


def workspace(spark: SparkSession, directory: str) -> Workspace:
    """The workspace of a directory. One is open at a time; the previous one is released."""
    _folder_for_tests(spark)
    key = (spark.sparkContext.applicationId, directory)
    if key not in _open:
        close_workspace(spark)
        sources = star_schema_sources(configure(spark), directory)
        _open[key] = Workspace(sources, COUNTRY, MAP_YEAR)
    return _open[key]


def close_workspace(spark: SparkSession) -> None:
    for application, directory in list(_open):
        kept = _open.pop((application, directory))
        if application == spark.sparkContext.applicationId:
            kept.release()


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as the order in which they are summed is not fixed."""
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema
        ]
    )


def _report(plan: Callable[..., DataFrame], years: int | None = None, **options) -> Query:
    def query(spark: SparkSession, directory: str) -> DataFrame:
        return rounded(plan(workspace(spark, directory).model_of_last(years), **options))

    return query


def _shared(build: Callable[[Workspace], DataFrame]) -> Query:
    return lambda spark, directory: rounded(build(workspace(spark, directory)))


def _returning(shared: Workspace) -> DataFrame:
    sources = shared.sources
    return returning_newcomers(sources.competitions, sources.results, RETURN_YEAR, COUNTRY, shared.pairs)


REPORTS: dict[str, Query] = {
    "q01_comps_per_quarter": _report(trends.competitions_per_quarter),
    "q02_comps_per_month": _report(trends.competitions_per_month),
    "q03_comps_ytd": _report(trends.competitions_year_to_date),
    "q04_attendance_stats": _report(trends.attendance_per_quarter),
    "q05_unique_competitors": _report(activity.unique_competitors),
    "q06_new_vs_returning": _report(activity.new_vs_returning),
    "q07_newcomer_share": _report(activity.newcomer_share),
    "q08_starts_histogram": _report(activity.starts_histogram),
    "q09_consistently_active": _report(activity.consistently_active),
    "q10_activity_trend": _report(activity.activity_trend),
    "q11_debuts_per_quarter": _report(newcomers.debuts_per_quarter),
    "q12_debuts_per_month": _report(newcomers.debuts_per_month),
    "q13_cohort_retention": _report(newcomers.retention),
    "q15_return_distribution": _report(newcomers.return_distribution),
    "q16_series_heatmap": _report(recurring.series_heatmap),
    "q17_series_trend": _report(recurring.series_trend),
    "q18_top_by_newcomers": _report(attraction.top_by_newcomers),
    "q19_top_by_share": _report(attraction.top_by_share, min_competitors=SMALL_FIELD),
    "q20_city_bubbles": _report(attraction.city_bubbles),
    "q21_by_calendar_month": _report(attraction.by_calendar_month),
    "q22_by_event": _report(attraction.by_event_offered),
    "q23_returning_newcomers": _shared(_returning),
    "q24_density_all": _shared(lambda w: travel.density_all(w.map)),
    "q25_regions": _shared(lambda w: w.regions),
    "q26_person_spread": _shared(lambda w: w.spread),
    "q27_globetrotters": _shared(lambda w: travel.globetrotters(w.map, w.spread)),
    "q28_density_locals": _shared(lambda w: travel.density_locals(w.map, w.spread)),
    "q29_region_summary": _shared(lambda w: travel.locals_by_region(w.map, w.regions, w.spread)),
    "q30_period_summary": _report(summary.period_summary),
    "q31_map_summary": _shared(lambda w: travel.map_summary(w.map, w.spread)),
}

LAST_YEARS: dict[str, Query] = {
    "q01_comps_per_quarter_last5": _report(trends.competitions_per_quarter, 5),
    "q02_comps_per_month_last1": _report(trends.competitions_per_month, 1),
    "q03_comps_ytd_last3": _report(trends.competitions_year_to_date, 3),
    "q04_attendance_stats_last5": _report(trends.attendance_per_quarter, 5),
    "q05_unique_competitors_last5": _report(activity.unique_competitors, 5),
    "q06_new_vs_returning_last5": _report(activity.new_vs_returning, 5),
    "q07_newcomer_share_last3": _report(activity.newcomer_share, 3),
    "q08_starts_histogram_last2": _report(activity.starts_histogram, 2),
    "q09_consistently_active_last5": _report(activity.consistently_active, 5),
    "q10_activity_trend_last99": _report(activity.activity_trend, 99),
    "q11_debuts_per_quarter_last5": _report(newcomers.debuts_per_quarter, 5),
    "q12_debuts_per_month_last2": _report(newcomers.debuts_per_month, 2),
    "q13_cohort_retention_last5": _report(newcomers.retention, 5),
    "q15_return_distribution_last5": _report(newcomers.return_distribution, 5),
    "q16_series_heatmap_last5": _report(recurring.series_heatmap, 5),
    "q16_series_heatmap_last2": _report(recurring.series_heatmap, 2),
    "q17_series_trend_last3": _report(recurring.series_trend, 3),
    "q18_top_by_newcomers_last5": _report(attraction.top_by_newcomers, 5),
    "q19_top_by_share_last5": _report(attraction.top_by_share, 5, min_competitors=SMALL_FIELD),
    "q20_city_bubbles_last1": _report(attraction.city_bubbles, 1),
    "q21_by_calendar_month_last5": _report(attraction.by_calendar_month, 5),
    "q22_by_event_last5": _report(attraction.by_event_offered, 5),
}

VARIANTS: dict[str, Query] = {
    "q08_starts_histogram_cap3": _report(activity.starts_histogram, cap=3),
    "q15_return_distribution_cap4": _report(newcomers.return_distribution, cap=4),
    # Budgets so small that every search of the map takes its boxes apart.
    "q25_regions_fine_boxes": _shared(lambda w: travel.regions(w.map, pair_budget=1)),
    "q26_person_spread_fine_boxes": _shared(
        lambda w: travel.spread(w.map, w.regions, points_in_row=1, pair_budget=4)
    ),
}

TABLES: dict[str, Query] = {
    "table_competitions": _shared(lambda w: w.sources.competitions),
    "table_results": _shared(lambda w: w.sources.results),
    "table_persons": _shared(lambda w: w.sources.persons),
    "table_current_persons": _shared(lambda w: w.model.persons),
    "table_first_dates": _shared(lambda w: w.model.first_dates),
    "table_attendance": _shared(lambda w: w.full_model.attendance),
    "table_attendance_last2": _shared(lambda w: last_years(w.full_model, 2).attendance),
    "table_debuts": _report(lambda m: debuts(m.attendance)),
    "table_followups": _report(lambda m: followups(m.attendance)),
    "table_return_counts": _report(lambda m: return_counts(m.attendance)),
    "table_competition_stats": _report(attraction.competition_stats),
    "table_series_by_year": _report(recurring.series_by_year),
    "table_series_matrix": _report(recurring.series_wide),
}

UPKEEP: dict[str, Query] = {
    "ledger_attendance": _shared(lambda w: w.ledger.attendance),
    "ledger_first_dates": _shared(lambda w: w.ledger.first_dates),
    "growing_regions": _shared(lambda w: w.grown_regions),
    "persons_by_span": _shared(lambda w: upkeep.spans_of_persons(w.rollup)),
    "stored_retention": _shared(lambda w: newcomers.retention(w.stored_model)),
    "stored_return_distribution": _shared(lambda w: newcomers.return_distribution(w.stored_model)),
    "stored_followups": _shared(lambda w: followups(w.stored_model.attendance, w.stored_model.person_days)),
    "stored_starts_last2": _shared(lambda w: activity.starts_histogram(last_years(w.stored_model, 2))),
    "quarantine_report": _shared(lambda w: rejection_report(w.checked)),
}


def all_queries() -> dict[str, Query]:
    return {**REPORTS, **LAST_YEARS, **VARIANTS, **TABLES, **UPKEEP}
