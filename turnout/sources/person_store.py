"""A model stored in buckets of persons, so that reports by person read it without shuffling rows.

``person_days`` has one row per person and day and lies in buckets by person. A person has at most as
many rows there as days in the calendar, so nobody fills a bucket, however often they start. The
attendance rows, of which one person may hold a large part, lie in buckets by person and day. A bucket
of either is sorted by day, so a report on a period skips the row groups of other years.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnout.operators.attendance import AttendanceModel
from turnout.sources import versions

# Columns by which each table lies in buckets; events are few and lie in plain files.
BUCKETED = {
    "attendance": ("person_id", "date"),
    "person_days": ("person_id",),
    "persons": ("person_id",),
    "first_dates": ("person_id",),
}


def person_days(attendance: DataFrame) -> DataFrame:
    """(person_id, date, year, quarter, is_newcomer, n_starts): one row per person and day."""
    # All but the count follow from person and day; as keys they need no aggregate of their own.
    return attendance.groupBy("person_id", "date", "year", "quarter", "is_newcomer").agg(
        F.count(F.lit(1)).alias("n_starts")
    )


def _order(columns: Sequence[str], keys: Sequence[str]) -> list[str]:
    """What a bucket is sorted by: the day first, if it has one."""
    return ["date", "person_id"] if "date" in columns else list(keys)


def _write_bucketed(df: DataFrame, path: str, buckets: int, keys: Sequence[str]) -> None:
    """One file per bucket. The catalog entry serves the writer only."""
    spark = df.sparkSession
    name = f"turnout_draft_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *keys).write.format("parquet").option("path", path)
    try:
        writer.bucketBy(buckets, *keys).sortBy(*_order(df.columns, keys)).saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def write_person_store(model: AttendanceModel, directory: str, buckets: int) -> None:
    """Write the model as a new version of the store; readers keep the one before until it is whole.

    A bucket is read by one task: take so many that one of the attendance has some hundred megabytes.
    Attendance is shuffled once for its buckets, the days once more after they were pre-aggregated.
    """
    spark = model.attendance.sparkSession
    before = versions.current(spark, directory)
    folder = versions.new_folder()
    tables = {}
    for name in ("competitions", *BUCKETED):
        part, path = f"{folder}/{name}", f"{directory}/{folder}/{name}"
        if name == "person_days":
            # Days come from the rows just written: where both lie by person and day, they need no shuffle.
            df = person_days(_registered(spark, directory, "attendance", tables["attendance"], buckets))
        else:
            df = getattr(model, name)
        if name in BUCKETED:
            _write_bucketed(df, path, buckets, BUCKETED[name])
        else:
            df.write.parquet(path)
        tables[name] = versions.Table(df.schema, {"": (part,)})
    number = before.number + 1 if before else 1
    versions.publish(spark, directory, versions.Version(number, tables, {"buckets": buckets}))


def _registered(
    spark: SparkSession, directory: str, name: str, table: versions.Table, buckets: int
) -> DataFrame:
    """The files of a table under a name of the session's catalog, which is what knows of buckets."""
    ((part,),) = table.parts.values()
    path = f"{directory}/{part}".replace("\\", "\\\\").replace("'", "\\'")
    keys = ", ".join(BUCKETED[name])
    order = ", ".join(_order(table.schema.names, BUCKETED[name]))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    # A data folder is written once and has a name of its own, so an entry never goes stale.
    entry = f"turnout_{part.replace('/', '_').replace('-', '_')}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {entry} ({columns}) USING parquet "
        f"CLUSTERED BY ({keys}) SORTED BY ({order}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(entry)


def read_person_store(spark: SparkSession, directory: str) -> AttendanceModel:
    """The stored model with ``person_days``, from which reports by person are then computed."""
    version = versions.current(spark, directory)
    if version is None:
        raise ValueError(f"no model was published in {directory}")
    buckets = int(version.settings["buckets"])
    found = {
        name: _registered(spark, directory, name, table, buckets)
        if name in BUCKETED
        else versions.read_part(spark, directory, table)
        for name, table in version.tables.items()
    }
    return AttendanceModel(**found)
