"""Calendar expressions over plain year / month / day integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_from_parts(year: Column, month: Column, day: Column, lenient: bool = False) -> Column:
    """Date from three integers. An impossible date raises, or is null when ``lenient``."""
    if not lenient:
        return F.make_date(year, month, day)
    midnight = F.lit(0)
    return F.try_make_timestamp(year, month, day, midnight, midnight, midnight).cast("date")


def quarter_of(month: Column) -> Column:
    """Calendar quarter 1-4 of a month number."""
    return F.ceil(month / F.lit(3)).cast("int")


def quarter_label(year: Column, quarter: Column) -> Column:
    """``2024 Q1``"""
    return F.concat(year.cast("string"), F.lit(" Q"), quarter.cast("string"))


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)
