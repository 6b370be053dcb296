"""Text expressions for event names, labels and token lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations used in series labels.
MONTH_ABBREVIATIONS = (
    "Sty", "Lut", "Mar", "Kwi", "Maj", "Cze", "Lip", "Sie", "Wrz", "Paź", "Lis", "Gru",
)

# Display names of the puzzle events.
EVENT_NAMES = {
    "333": "3x3x3",
    "222": "2x2x2",
    "444": "4x4x4",
    "555": "5x5x5",
    "666": "6x6x6",
    "777": "7x7x7",
    "333bf": "3x3 Blindfolded",
    "333oh": "3x3 One-Handed",
    "clock": "Clock",
    "minx": "Megaminx",
    "pyram": "Pyraminx",
    "skewb": "Skewb",
    "sq1": "Square-1",
    "444bf": "4x4 Blindfolded",
    "555bf": "5x5 Blindfolded",
    "333mbf": "Multi-Blind",
    "333ft": "3x3 With Feet",
}


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def series_name(name: Column) -> Column:
    """An event name without its standalone four-digit years and surplus white space.

    ``(?U)`` keeps word boundaries and white space Unicode-aware on every JDK.
    """
    without_years = F.regexp_replace(name, r"(?U)\b\d{4}\b", "")
    stripped = F.regexp_replace(without_years, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(stripped, r"(?U)\s+", " ")


def with_month(label: Column, month: Column, names: Sequence[str] = MONTH_ABBREVIATIONS) -> Column:
    """``Open Spring (Maj)``; the bare label when the month is unknown."""
    abbreviation = F.element_at(F.array(*[F.lit(n) for n in names]), month)
    return F.when(month.isNull(), label).otherwise(
        F.concat(label, F.lit(" ("), abbreviation, F.lit(")"))
    )


def shorten(label: Column, limit: int = 38, keep: int = 35) -> Column:
    """Labels longer than ``limit`` become their first ``keep`` characters and ``...``."""
    return F.when(
        F.length(label) > limit, F.concat(F.substring(label, 1, keep), F.lit("..."))
    ).otherwise(label)


def tokens(text: Column) -> Column:
    """Array of the white-space separated tokens; no empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda token: token != "")


def display_name(code: Column, names: dict[str, str]) -> Column:
    """Name looked up in a small fixed dictionary, falling back to the code itself."""
    if not names:
        return code
    pairs = [F.lit(item) for pair in names.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)
