"""The attendance table: one row per event and participant, with the participant's first date."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnout.functions.dates import date_from_parts, quarter_of
from turnout.sources.tables import Sources

# Columns of an event that travel with every attendance row.
EVENT_COLUMNS = (
    "date", "year", "month", "quarter",
    "city_name", "latitude_microdegrees", "longitude_microdegrees",
)


@dataclass(frozen=True)
class AttendanceModel:
    """What the reports read.

    ``competitions`` and ``attendance`` cover one country; ``first_dates`` covers every country
    and all history, whatever period the other two are later restricted to. ``event_stats``, if a
    caller computed it for several reports, has one row per event of ``attendance``. ``event_sizes``,
    likewise, has (competition_id, n_competitors) of at least these events, and asks no debuts.
    ``person_days``, if the model comes from a store in buckets, has one row per person and day of
    ``attendance``.
    """

    competitions: DataFrame
    attendance: DataFrame
    persons: DataFrame
    first_dates: DataFrame
    event_stats: DataFrame | None = None
    event_sizes: DataFrame | None = None
    person_days: DataFrame | None = None

    @property
    def by_person(self) -> DataFrame:
        """What reports by person read: the days of persons if stored, with their numbers of starts."""
        if self.person_days is not None:
            return self.person_days
        return self.attendance.withColumn("n_starts", F.lit(1).cast("long"))


def with_dates(competitions: DataFrame, lenient: bool = False) -> DataFrame:
    """Events keyed by ``competition_id`` with ``date``; ``lenient`` drops impossible dates."""
    dated = competitions.withColumnRenamed("id", "competition_id").withColumn(
        "date", date_from_parts(F.col("year"), F.col("month"), F.col("day"), lenient)
    )
    return dated.where(F.col("date").isNotNull()) if lenient else dated


def held_in(competitions: DataFrame, country: str) -> DataFrame:
    """Events of one country that took place; an unknown ``cancelled`` counts as cancelled."""
    return competitions.where((F.col("country_id") == country) & (F.col("cancelled") == 0))


def current_persons(persons: DataFrame) -> DataFrame:
    """The current record of every person."""
    return persons.where(F.col("sub_id") == 1).select(
        "person_id", "name", F.col("country_id").alias("person_country")
    )


def participations(results: DataFrame) -> DataFrame:
    """Distinct (event, person) pairs of all results.

    Grouped on both keys and pre-aggregated in every task, so neither a crowded event nor a busy
    person gathers in one task. Everything else starts from this table, and Spark shuffles it once.
    """
    keyed = results.where(F.col("competition_id").isNotNull() & F.col("person_id").isNotNull())
    return keyed.select("competition_id", "person_id").distinct()


def first_dates(pairs: DataFrame, competitions: DataFrame) -> DataFrame:
    """Date of each person's first event, in any country, cancelled events included."""
    return earliest(pairs.join(competitions.select("competition_id", "date"), "competition_id"))


def earliest(dated: DataFrame) -> DataFrame:
    return dated.groupBy("person_id").agg(F.min("date").alias("first_comp_date"))


def mark_debuts(attendance: DataFrame, firsts: DataFrame) -> DataFrame:
    """Adds ``is_newcomer``: the event is on the person's first date.

    Joined on person and date, so the rows of a person who is everywhere are spread by day.
    """
    debut_days = firsts.select(
        "person_id", F.col("first_comp_date").alias("date"), F.lit(True).alias("is_newcomer")
    )
    return attendance.join(debut_days, ["person_id", "date"], "left").withColumn(
        "is_newcomer", F.coalesce("is_newcomer", F.lit(False))
    )


def with_person_columns(
    attendance: DataFrame, per_person: DataFrame, how: str = "inner", days: DataFrame | None = None
) -> DataFrame:
    """Attendance with the columns of a table that has one row per person.

    The table is joined to the person's distinct days first, of which there are no more than days
    in the calendar, and the result to the rows by person and day. A join by person alone would
    send every row of a busy person to one task, and the adaptive skew split does not apply
    where the other side comes straight from an aggregate on the same key. ``days`` has these days
    if the caller stores them, one row per person and day.
    """
    if days is None:
        days = attendance.select("person_id", "date").distinct()
    known = days.select("person_id", "date").join(per_person, "person_id")
    return attendance.join(known, ["person_id", "date"], how)


def placed_pairs(pairs: DataFrame, every_event: DataFrame, country: str) -> DataFrame:
    """The pairs with the columns of their event, and ``held``: whether it took place in the country."""
    held = F.coalesce((F.col("country_id") == country) & (F.col("cancelled") == 0), F.lit(False))
    events = every_event.withColumn("quarter", quarter_of(F.col("month")))
    return pairs.join(events.select("competition_id", *EVENT_COLUMNS, held.alias("held")), "competition_id")


def build_attendance(
    sources: Sources,
    country: str,
    lenient_dates: bool = False,
    pairs: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> AttendanceModel:
    """Attendance of one country, with debuts judged over the whole history of all countries.

    ``pairs`` are the ``participations`` of the results if the caller keeps them for other reports too.
    A caller that writes several of the model's tables may give ``keep``, which persists what they share:
    the pairs then meet their events once, and first dates are found once.
    """
    every_event = with_dates(sources.competitions, lenient_dates)
    events = held_in(every_event, country).withColumn("quarter", quarter_of(F.col("month")))
    pairs = participations(sources.results) if pairs is None else pairs
    if keep is None:
        firsts = first_dates(pairs, every_event)
        at_home = pairs.join(events.select("competition_id", *EVENT_COLUMNS), "competition_id")
    else:
        placed = keep(placed_pairs(pairs, every_event, country))
        firsts = keep(earliest(placed))
        at_home = placed.where("held").drop("held")
    # The left join costs nothing in reports that do not read first_comp_date: its right side has
    # one row per key, so the optimizer drops it.
    attendance = with_person_columns(mark_debuts(at_home, firsts), firsts, "left")
    return AttendanceModel(
        competitions=events,
        attendance=attendance,
        persons=current_persons(sources.persons),
        first_dates=firsts,
    )
