"""The tables that many reports of one data set share, each computed once."""

from __future__ import annotations

import uuid
from dataclasses import fields, replace
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from turnout.operators.attendance import AttendanceModel, build_attendance, participations
from turnout.operators.attractors import newcomer_counts, with_event_attributes
from turnout.operators.lineage import shared_folder
from turnout.operators.periods import last_years
from turnout.operators.series import event_sizes
from turnout.plans import travel, upkeep
from turnout.sources.ledger import create_ledger, read_ledger, update_ledger
from turnout.sources.person_store import read_person_store, write_person_store
from turnout.sources.quarantine import Checked, ingest_sources
from turnout.sources.region_map import add_events, create_map, map_regions
from turnout.sources.tables import Sources

# What the reports read of an attendance row; the columns of its event stay with the event.
REPORTED = ("competition_id", "person_id", "date", "year", "month", "quarter", "is_newcomer")


class Workspace:
    """Attendance model and year map of one country over one set of sources.

    What is kept is small beside the results: rows and columns that the reports of the country read, in
    memory and on disk of the executors; what an executor loses is recomputed. Nothing is computed before
    the first report asks for it. The pairs of all countries and the events are not kept for the model: a
    plan reads them in one shuffle each, which leaves the memory to its joins.
    """

    def __init__(self, sources: Sources, country: str, map_year: int):
        self.sources = sources
        self.country = country
        self.map_year = map_year
        self._kept: list[DataFrame] = []

    def _keep(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    @cached_property
    def pairs(self) -> DataFrame:
        """Who took part where, of all countries: the one pass over the results."""
        return self._keep(participations(self.sources.results))

    @cached_property
    def full_model(self) -> AttendanceModel:
        """Every column; nothing is kept."""
        return build_attendance(self.sources, self.country)

    @cached_property
    def model(self) -> AttendanceModel:
        """What the reports read, each part computed for the first report that reads it.

        Sizes of events need no debuts, and counts per event no rows that are kept.
        """
        whole = self.full_model
        counts = self._keep(newcomer_counts(whole.attendance))
        return replace(
            whole,
            attendance=self._keep(whole.attendance.select(*REPORTED)),
            event_stats=with_event_attributes(counts, whole.competitions),
            event_sizes=self._keep(event_sizes(whole.attendance)),
        )

    def model_of_last(self, years: int | None) -> AttendanceModel:
        return last_years(self.model, years)

    @cached_property
    def map(self) -> travel.YearMap:
        return travel.year_map(self.sources, self.map_year, self.country, self._keep)

    @cached_property
    def regions(self) -> DataFrame:
        return self._keep(travel.regions(self.map))

    @cached_property
    def spread(self) -> DataFrame:
        return self._keep(travel.spread(self.map, self.regions))

    @cached_property
    def folder(self) -> str:
        """Where the workspace writes tables that it reads again."""
        spark = self.sources.results.sparkSession
        return f"{shared_folder(spark)}/workspace-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"

    @cached_property
    def ledger(self) -> AttendanceModel:
        """The model once more, merged from batches that arrive out of order."""
        spark = self.sources.results.sparkSession
        arrived = {}
        for table in fields(self.sources):
            path = f"{self.folder}/arrived/{table.name}"
            df = getattr(self.sources, table.name)
            df.write.parquet(path)
            arrived[table.name] = spark.read.schema(df.schema).parquet(path)
        directory = f"{self.folder}/ledger"
        # Few buckets, as the batches are small; a large ledger takes more.
        create_ledger(spark, directory, self.country, buckets=8)
        for batch in upkeep.late_batches(Sources(**arrived)):
            update_ledger(spark, directory, batch)
        return read_ledger(spark, directory)

    @cached_property
    def grown_regions(self) -> DataFrame:
        """The regions once more, of a map that gets its events in batches."""
        spark = self.sources.results.sparkSession
        directory = f"{self.folder}/map"
        create_map(spark, directory)
        for batch in upkeep.dealt(self.map.events, 3, "competition_id"):
            add_events(spark, directory, batch)
        return map_regions(spark, directory)

    @cached_property
    def stored_model(self) -> AttendanceModel:
        """The model once more, read from buckets of persons."""
        spark = self.sources.results.sparkSession
        directory = f"{self.folder}/persons"
        # Few buckets, as the tables are small; a large model takes more.
        # The store has rows and first dates, both of the pairs: what they share is kept while it is written.
        kept: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
            return df

        whole = build_attendance(self.sources, self.country, keep=keep)
        try:
            write_person_store(replace(whole, attendance=whole.attendance.drop("first_comp_date")), directory, buckets=8)
        finally:
            for df in kept:
                df.unpersist()
        return read_person_store(spark, directory)

    @cached_property
    def rollup(self) -> DataFrame:
        return self._keep(upkeep.rollup_of(self.model))

    @cached_property
    def checked(self) -> dict[str, Checked]:
        """The sources as text with planted faults, after the bad rows were set aside."""
        return ingest_sources(*upkeep.faulty_text(self.sources), f"{self.folder}/checked")[1]

    def release(self) -> None:
        """Free what is kept; reports built from it stay valid and recompute it."""
        for df in self._kept:
            df.unpersist()
        self._kept.clear()
