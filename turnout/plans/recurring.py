"""Heat map and trend of the recurring series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnout.functions.text import shorten
from turnout.operators.attendance import AttendanceModel
from turnout.operators.lineage import cut
from turnout.operators.series import (
    dense_years,
    held_years,
    recurring_series,
    series_matrix,
    series_years,
    top_series,
)
from turnout.plans.trends import field_sizes

# Series drawn, and the part of the maximum above which a cell is dark.
HEATMAP_SERIES = 30
TREND_SERIES = 10
DARK_ABOVE = 0.65


def _series(model: AttendanceModel) -> DataFrame:
    return recurring_series(model.competitions, model.attendance, sizes=field_sizes(model))


def _series_and_years(model: AttendanceModel) -> tuple[DataFrame, DataFrame]:
    """The series, stored as they are read twice, and the years of any of them."""
    series = cut(_series(model))
    return series, series_years(series)


def series_heatmap(model: AttendanceModel, limit: int = HEATMAP_SERIES) -> DataFrame:
    """Cells of the ``limit`` leading series, empty years included, with text and shade.

    The window for the overall maximum spans ``limit`` series times the years of the data.
    """
    series, years = _series_and_years(model)
    cells = dense_years(top_series(series, limit), years)
    n = F.col("n_competitors")
    peak = F.max(n).over(Window.partitionBy())
    return cells.select(
        "rank", "series", "label", "year", "n_competitors", "editions", "total",
        F.when(n > 0, n.cast("string")).otherwise("—").alias("cell_text"),
        F.when(n > peak * DARK_ABOVE, "dark").when(n > 0, "light").otherwise("empty").alias("shade"),
    ).orderBy("rank", "year")


def series_trend(model: AttendanceModel, limit: int = TREND_SERIES) -> DataFrame:
    """Attendance of the leading series in the years they were held."""
    return (
        held_years(top_series(_series(model), limit))
        .select("rank", shorten(F.col("label")).alias("label"), "year", "n_competitors")
        .orderBy("rank", "year")
    )


def series_by_year(model: AttendanceModel) -> DataFrame:
    """All recurring series, long form, empty years included."""
    series, years = _series_and_years(model)
    return dense_years(series, years).select(
        "series", "label", "year", "n_competitors", "editions", "total"
    )


def series_wide(model: AttendanceModel) -> DataFrame:
    """All recurring series as a matrix with one column per year in which any series ran.

    Column names have to be known when a DataFrame is built, so the short list of years is read
    first.
    """
    series, years = _series_and_years(model)
    return series_matrix(series, years.first()["years"])
