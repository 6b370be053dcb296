"""An attendance model that is kept up to date: each batch of new rows is merged, history stays unread.

The ledger holds the first date of every person anywhere, the attendance of one country with its
debuts marked, the dates of all events, and results whose event is not known yet. A batch is merged by
reading the batch, the buckets of its persons and events, and the years in which attendance changes:
those of its events, and of first dates that a late result moves back.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.functions.dates import quarter_of
from turnout.operators.attendance import (
    EVENT_COLUMNS,
    AttendanceModel,
    current_persons,
    first_dates,
    held_in,
    mark_debuts,
    participations,
    with_dates,
)
from turnout.sources import versions
from turnout.sources.tables import COMPETITIONS, PERSONS, Sources
from turnout.sources.versions import Table, Version

# Buckets of persons and of events. A batch reads and writes those that it has rows of.
BUCKETS = 64
PAIR = ["competition_id", "person_id"]
# Columns of an event from which those of an attendance row follow.
EVENT_DATES = [c for c in EVENT_COLUMNS if c != "quarter"]


def _bucket(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def _values(df: DataFrame, column: str) -> list:
    """The distinct values of a bucket or year column, of which there are few."""
    return sorted(r[0] for r in df.select(column).distinct().collect())


def _home(events: DataFrame, country: str) -> DataFrame:
    return held_in(events, country).withColumn("quarter", quarter_of(F.col("month")))


def create_ledger(
    spark: SparkSession, directory: str, country: str, buckets: int = BUCKETS, lenient_dates: bool = False
) -> Version:
    """An empty ledger for the attendance of one country. Fails if the directory has one."""
    if versions.numbers(spark, directory):
        raise ValueError(f"{directory} holds a ledger already")
    names = ("events", "first_dates", "attendance", "persons", "waiting")
    rows = _batch(Sources(*(spark.createDataFrame([], s) for s in (COMPETITIONS, _RESULTS, PERSONS))), country, False)
    settings = {"country": country, "buckets": buckets, "lenient_dates": lenient_dates}
    tables = {name: Table(rows[name].schema, {}) for name in names}
    return versions.publish(spark, directory, Version(1, tables, settings))


_RESULTS = "competition_id string, person_id string, person_country_id string"


def _batch(sources: Sources, country: str, lenient: bool) -> dict[str, DataFrame]:
    """The ledger's tables as they would be for these rows alone; used for their schemas."""
    events = with_dates(sources.competitions, lenient)
    pairs = participations(sources.results)
    firsts = first_dates(pairs, events)
    at_home = pairs.join(_home(events, country).select("competition_id", *EVENT_COLUMNS), "competition_id")
    return {
        "events": events,
        "first_dates": firsts,
        "attendance": _attendance_columns(mark_debuts(at_home, firsts)),
        "persons": current_persons(sources.persons),
        "waiting": pairs,
    }


def _attendance_columns(rows: DataFrame) -> DataFrame:
    return rows.select(*PAIR, *EVENT_COLUMNS, "is_newcomer")


class _Kept:
    """Tables of one update that are used more than once, freed at its end."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def __enter__(self) -> _Kept:
        return self

    def __exit__(self, *_) -> None:
        for df in self.tables:
            df.unpersist()


def update_ledger(spark: SparkSession, directory: str, batch: Sources) -> Version:
    """Merge a batch of new events, results and persons, and publish the ledger's next version.

    After any batches in any order the ledger equals a full build over all their rows. Results may
    come again, before their event, or long after it; a first date that moves back takes the debut mark
    off the person's old debut day. Events may come again as they are. An event that comes with other
    columns is refused: dates that are corrected, unlike dates that are added, need the whole history.
    A run that fails leaves the ledger as it was. Two runs at once: the later one fails.
    """
    ledger = versions.current(spark, directory)
    if ledger is None:
        raise ValueError(f"no ledger in {directory}")
    country, buckets = str(ledger.settings["country"]), int(ledger.settings["buckets"])
    folder = versions.new_folder()

    def stored(name: str, parts: Iterable[object]) -> DataFrame:
        return versions.read_part(spark, directory, ledger.tables[name], parts)

    with _Kept() as kept:
        events = with_dates(batch.competitions, bool(ledger.settings["lenient_dates"]))
        absent = [f for f in ledger.tables["events"].schema if f.name not in events.columns]  # such as end_date
        events = events.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in absent))
        event_buckets = _values(events.withColumn("b", _bucket("competition_id", buckets)), "b")
        fresh = _new_events(kept, events, stored("events", event_buckets))

        # Results that waited for these events, and the dates of all events that the results name.
        waited = stored("waiting", event_buckets).join(fresh.select("competition_id"), "competition_id", "left_semi")
        pairs = kept(participations(batch.results.select(*PAIR).unionByName(waited.select(*PAIR))))
        named = sorted({*event_buckets, *_values(pairs.withColumn("b", _bucket("competition_id", buckets)), "b")})
        known = stored("events", named).unionByName(fresh)

        # One join says of every pair when its event was, whether it is the country's, and whether it is known.
        held = F.coalesce((F.col("country_id") == country) & (F.col("cancelled") == 0), F.lit(False))
        dates = known.select("competition_id", *EVENT_DATES, held.alias("_held"), F.lit(True).alias("_known"))
        placed = kept(pairs.join(dates, "competition_id", "left"))
        waiting = placed.where(F.col("_known").isNull()).select(*pairs.columns)
        at_known = placed.where("_known")

        # First dates: the least of what is stored and what the batch brings.
        person_buckets = _values(at_known.withColumn("b", _bucket("person_id", buckets)), "b")
        seen = kept(_first_dates_seen(stored("first_dates", person_buckets), at_known))
        firsts = _earlier(seen)
        moved = kept(seen.where(F.col("new_date") < F.col("old_date")).select("person_id", F.col("old_date").alias("date")))

        # Attendance of the country: rows to add, and rows whose debut mark goes.
        at_home = at_known.where("_held").select(*pairs.columns, *EVENT_DATES)
        at_home = at_home.withColumn("quarter", quarter_of(F.col("month"))).select(*PAIR, *EVENT_COLUMNS)
        own_firsts = _earlier(seen.where(F.col("new_date").isNotNull()))
        added = kept(_attendance_columns(mark_debuts(at_home, own_firsts)))
        old_years = [y for y in _values(moved.withColumn("y", F.year("date")), "y") if str(y) in ledger.tables["attendance"].parts]
        lost = stored("attendance", old_years).where("is_newcomer").join(moved, ["person_id", "date"], "left_semi")
        years = sorted({*_values(added, "year"), *_values(lost, "year")})
        rows = _merged(stored("attendance", years), added, moved)

        staged = {
            "events": versions.stage(
                fresh.withColumn("_bucket", _bucket("competition_id", buckets)), directory, f"{folder}/events", "_bucket"
            ),
            "waiting": versions.stage(
                waiting.withColumn("_bucket", _bucket("competition_id", buckets)), directory, f"{folder}/waiting", "_bucket"
            ),
            "first_dates": versions.stage(
                firsts.withColumn("_bucket", _bucket("person_id", buckets)), directory, f"{folder}/first_dates", "_bucket"
            ),
            "attendance": versions.stage(rows, directory, f"{folder}/attendance", "year"),
            "persons": versions.stage(current_persons(batch.persons), directory, f"{folder}/persons"),
        }
    whole = {"first_dates", "attendance"}  # parts of these are written anew, the others grow
    tables = {
        name: ledger.tables[name].with_parts(table.parts, append=name not in whole) for name, table in staged.items()
    }
    return versions.publish(spark, directory, replace(ledger, number=ledger.number + 1, tables=tables))


def _new_events(kept: _Kept, events: DataFrame, stored: DataFrame) -> DataFrame:
    """The events that are not stored yet; stored ones must come as they are.

    Whole rows of the batch are dealt out once, by the key that all steps share. Of the stored events the
    keys are read, and whole rows only if some of them come again.
    """
    ids = stored.select("competition_id", F.lit(True).alias("_stored")).distinct()
    marked = kept(events.repartition("competition_id").distinct().join(ids, "competition_id", "left"))
    again = marked.where("_stored").select(*stored.columns)
    if not again.isEmpty():
        before = stored.join(again.select("competition_id"), "competition_id", "left_semi")
        sample = [r["competition_id"] for r in again.subtract(before).select("competition_id").limit(5).collect()]
        if sample:
            raise ValueError(f"stored events come with other columns, so the ledger has to be built anew: {sample}")
    return marked.where(F.col("_stored").isNull()).select(*stored.columns)


def _first_dates_seen(stored: DataFrame, dated: DataFrame) -> DataFrame:
    """(person_id, old_date, new_date): a person's first date as stored, and in the batch; either may be null."""
    none = F.lit(None).cast("date")
    old = stored.select("person_id", F.col("first_comp_date").alias("old_date"), none.alias("new_date"))
    new = dated.select("person_id", none.alias("old_date"), F.col("date").alias("new_date"))
    return old.unionByName(new).groupBy("person_id").agg(F.min("old_date").alias("old_date"), F.min("new_date").alias("new_date"))


def _earlier(seen: DataFrame) -> DataFrame:
    return seen.select("person_id", F.least("old_date", "new_date").alias("first_comp_date"))


def _merged(before: DataFrame, added: DataFrame, moved: DataFrame) -> DataFrame:
    """Attendance of some years with the batch's rows. A row that is there already stays one row.

    Only rows with a debut mark can lose it, so only these meet the first dates that moved.
    """
    unmarked = moved.withColumn("_moved", F.lit(True))
    debuts = before.where("is_newcomer").join(unmarked, ["person_id", "date"], "left").withColumn(
        "is_newcomer", F.col("_moved").isNull()
    )
    new = added.join(before.select(*PAIR), PAIR, "left_anti")
    return before.where(~F.col("is_newcomer")).unionByName(_attendance_columns(debuts)).unionByName(new)


def read_ledger(spark: SparkSession, directory: str, number: int | None = None) -> AttendanceModel:
    """The model as the reports take it, without ``first_comp_date`` on attendance rows, which none reads."""
    ledger = versions.current(spark, directory, number)
    if ledger is None:
        raise ValueError(f"no ledger in {directory}")

    def table(name: str) -> DataFrame:
        return versions.read_part(spark, directory, ledger.tables[name])

    return AttendanceModel(
        competitions=_home(table("events"), str(ledger.settings["country"])),
        attendance=table("attendance"),
        persons=table("persons"),
        first_dates=table("first_dates"),
    )
