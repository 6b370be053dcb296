"""Dense month calendars and running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONTHS = range(1, 13)


def dense_month_counts(df: DataFrame, year: str = "year", month: str = "month") -> DataFrame:
    """Rows per month: twelve rows for each year present, zero where a month is empty.

    The twelve counts of a year are taken in one aggregate, so only one row per year and task is
    shuffled and no calendar has to be joined.
    """
    counts = df.groupBy(F.col(year).alias("year")).agg(
        F.array(*[F.count_if(F.col(month) == m) for m in MONTHS]).alias("counts")
    )
    return counts.select("year", F.posexplode("counts").alias("slot", "n")).select(
        "year", (F.col("slot") + 1).alias("month"), "n"
    )


def ytd_running_total(counts: DataFrame, value: str = "n") -> DataFrame:
    """Running total of ``value`` within each year, month by month."""
    through_month = (
        Window.partitionBy("year")
        .orderBy("month")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return counts.select("year", "month", F.sum(value).over(through_month).alias(f"{value}_ytd"))
