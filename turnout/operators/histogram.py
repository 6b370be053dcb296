"""Unit-width histograms and exact percentiles over value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str = "n_rows") -> DataFrame:
    """How often each value occurs per key: the small table that percentiles are taken from."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(weight))


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def weighted_percentile(value: str, q: float, weight: str) -> Column:
    """Exact percentile with linear interpolation of values that occur ``weight`` times."""
    return F.percentile(F.col(value), F.lit(q), F.col(weight))


def unit_bins(
    counts: DataFrame, keys: Sequence[str], value: str, weight: str, first: int, cap: int | None = None
) -> DataFrame:
    """(keys, ``bins``, ``counts``) per key; ``bins`` is an array of ``struct(bin, n)``.

    Bins run from ``first`` to the largest value, also where empty, so ``n`` adds up to all rows. With
    a ``cap`` the last bin holds ``cap`` and everything above. ``counts`` has one row per key and
    value, and its values are what the list of a key is as long as.
    """
    entry = F.struct(F.col(value).alias("value"), F.col(weight).alias("n"))
    listed = counts.groupBy(*keys).agg(F.collect_list(entry).alias("counts"))
    top = F.array_max(F.transform("counts", lambda e: e["value"]))
    last = F.greatest(top, F.lit(first)) if cap is None else F.least(F.greatest(top, F.lit(first)), F.lit(cap))
    by_value = F.map_from_entries("counts")
    above = F.aggregate(
        F.filter("counts", lambda e: e["value"] >= F.lit(cap)), F.lit(0).cast("long"), lambda s, e: s + e["n"]
    )

    def filled(b: Column) -> Column:
        exact = F.coalesce(F.try_element_at(F.col("by_value"), b), F.lit(0).cast("long"))
        n = exact if cap is None else F.when(b == cap, F.col("above")).otherwise(exact)
        return F.struct(b.alias("bin"), n.alias("n"))

    ranges = listed.select(
        *keys,
        "counts",
        by_value.alias("by_value"),
        (F.lit(0) if cap is None else above).alias("above"),
        F.sequence(F.lit(first).cast("long"), last.cast("long")).alias("range"),
    )
    return ranges.select(*keys, F.transform("range", filled).alias("bins"), "counts")
