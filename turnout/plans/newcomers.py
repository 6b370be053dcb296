"""Debuts over time, cohort retention and return counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnout.functions.dates import quarter_label
from turnout.functions.numbers import percentage
from turnout.operators.attendance import AttendanceModel
from turnout.operators.cohorts import cohort_retention, debuts, return_counts
from turnout.operators.dense import dense_month_counts
from turnout.operators.histogram import unit_bins, value_counts


def debuts_per_quarter(model: AttendanceModel) -> DataFrame:
    return (
        debuts(model.by_person)
        .groupBy(F.col("debut_year").alias("year"), F.col("debut_quarter").alias("quarter"))
        .agg(F.count(F.lit(1)).alias("newcomers"))
        .select(
            "year", "quarter", quarter_label(F.col("year"), F.col("quarter")).alias("label"),
            "newcomers",
        )
        .orderBy("year", "quarter")
    )


def debuts_per_month(model: AttendanceModel) -> DataFrame:
    return dense_month_counts(debuts(model.by_person), "debut_year", "debut_month")


def retention(model: AttendanceModel) -> DataFrame:
    return cohort_retention(model.by_person).orderBy("year", "quarter")


def return_distribution(model: AttendanceModel, cap: int | None = None) -> DataFrame:
    """Newcomers by number of later events, and the share that never returned; no row without newcomers.

    Every number of returns has its row. With a ``cap`` the last row holds all from there on.
    """
    counted = value_counts(return_counts(model.by_person), [], "returns", "n_persons")
    binned = unit_bins(counted, [], "returns", "n_persons", 0, cap).where(F.size("counts") > 0)

    def total(entries: Column) -> Column:
        return F.aggregate(entries, F.lit(0).cast("long"), lambda s, e: s + e["n"])

    return (
        binned.select(
            F.explode("bins").alias("item"),
            total(F.filter("counts", lambda e: e["value"] == 0)).alias("n_never"),
            total(F.col("counts")).alias("n_total"),
        )
        .select(
            F.col("item.bin").alias("returns"),
            F.col("item.n").alias("n_persons"),
            "n_never",
            "n_total",
            percentage(F.col("n_never"), F.col("n_total")).alias("pct_never"),
        )
        .orderBy("returns")
    )
