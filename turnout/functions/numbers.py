"""Ratios and percentages with a fixed rounding rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentage(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` as a double; null where ``whole`` is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)


def percentage_one_decimal(part: Column, whole: Column) -> Column:
    """Percentage rounded half-up to one decimal in integer arithmetic, 0.0 for an empty whole.

    Integers make the result the same on every engine; the usual binary rounding differs from it
    by 0.1 at most, on exact decimal ties only.
    """
    part, whole = part.cast("bigint"), whole.cast("bigint")
    tenths = F.floor((part * 2000 + whole) / (whole * 2))
    return F.when(whole > 0, tenths / F.lit(10.0)).otherwise(F.lit(0.0))
