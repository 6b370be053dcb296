"""Reading source tables that hold bad rows: what does not conform is set aside with its reasons.

A row is rejected if its line is malformed, a key is missing, a value is not of the declared type, or its
date does not exist. One pass over the input writes both kinds and counts them, so accepted and
rejected rows together are the rows that were read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnout.functions.dates import date_from_parts
from turnout.functions.text import empty_to_null
from turnout.sources.tables import (
    COMPETITIONS,
    LEFT_OUT_IF_MISSING,
    PERSONS,
    REQUIRED_OF_COMPETITIONS,
    REQUIRED_OF_PERSONS,
    RESULTS,
    Sources,
    read_delimited,
)

MALFORMED = "malformed line"
NO_SUCH_DATE = "no such date"
CORRUPT = "_corrupt_record"


def missing(name: str) -> str:
    return f"missing {name}"


def wrong(name: str) -> str:
    return f"wrong {name}"


@dataclass(frozen=True)
class Checked:
    """One table after :func:`ingest`: its rows of either kind, and how many there are of each."""

    accepted: DataFrame
    rejected: DataFrame
    counts: Mapping[str, int]


def judged(
    df: DataFrame,
    schema: T.StructType,
    rename: Mapping[str, str] | None = None,
    required: Sequence[str] = (),
) -> tuple[DataFrame, list[str]]:
    """The columns of ``schema``, ``reasons`` and ``raw`` for every row, and the reasons there can be.

    Columns are taken by name as in ``conform``; a column that is missing altogether is an error of the
    table, not of its rows. Empty text is null. ``reasons`` is empty for a row that conforms. ``raw``
    is a rejected row as it came, as JSON, or the line itself if it was malformed.
    """
    for source, target in (rename or {}).items():
        if source in df.columns:
            df = df.withColumnRenamed(source, target)
    given = [name for name in df.columns if name != CORRUPT]
    tests: list[tuple[str, Column]] = []
    if CORRUPT in df.columns:
        tests.append((MALFORMED, F.col(CORRUPT).isNotNull()))
    picked = {}
    for field in schema:
        name = field.name
        if name not in given:
            if not field.nullable or name in required:
                raise ValueError(f"missing column {name!r}; found {given}")
            if name not in LEFT_OUT_IF_MISSING:
                picked[name] = F.lit(None).cast(field.dataType)
            continue
        value = F.col(name)
        if isinstance(df.schema[name].dataType, T.StringType):
            value = empty_to_null(value)
        typed = value.try_cast(field.dataType)
        picked[name] = typed
        if not field.nullable:
            tests.append((missing(name), value.isNull()))
        if not isinstance(field.dataType, T.StringType):
            tests.append((wrong(name), value.isNotNull() & typed.isNull()))
    if {"year", "month", "day"} <= set(picked):
        parts = [picked[p] for p in ("year", "month", "day")]
        whole = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
        tests.append((NO_SUCH_DATE, whole & date_from_parts(*parts, lenient=True).isNull()))
    malformed = F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False)
    # A malformed line has no columns to judge: its fields may have slipped.
    reasons = F.array_compact(
        F.array(*[F.when(test if reason == MALFORMED else test & ~malformed, F.lit(reason)) for reason, test in tests])
    )
    line = F.to_json(F.struct(*given))
    raw = F.coalesce(F.col(CORRUPT), line) if CORRUPT in df.columns else line
    rows = df.select(
        *(column.alias(name) for name, column in picked.items()),
        reasons.alias("reasons"),
        F.when(F.size(reasons) > 0, raw).alias("raw"),
    )
    return rows, [reason for reason, _ in tests]


def ingest(
    df: DataFrame,
    directory: str,
    schema: T.StructType,
    rename: Mapping[str, str] | None = None,
    required: Sequence[str] = (),
) -> Checked:
    """Write the rows of ``df`` to ``directory``, the bad ones apart, in one pass, and count them.

    ``counts`` has ``read``, ``accepted``, ``rejected`` and one number per reason; a row may have
    several. Bad rows stay where they are read: nothing is shuffled, whatever their number.
    """
    rows, known = judged(df, schema, rename, required)
    seen = Observation()
    bad = F.size("reasons") > 0
    counts = {"read": F.lit(1), "accepted": (~bad).cast("int"), "rejected": bad.cast("int")}
    counts |= {reason: F.array_contains("reasons", reason).cast("int") for reason in known}
    sums = [F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name) for name, c in counts.items()]
    rows.observe(seen, *sums).withColumn("rejected", bad).write.partitionBy("rejected").parquet(directory)
    spark = df.sparkSession
    plain = T.StructType([f for f in rows.schema if f.name not in ("reasons", "raw")])
    found = {name: int(n) for name, n in seen.get.items()}
    return Checked(
        _kind(spark, directory, "false", plain, found["accepted"]),
        _kind(spark, directory, "true", rows.schema, found["rejected"]),
        found,
    )


def _kind(spark: SparkSession, directory: str, rejected: str, schema: T.StructType, n: int) -> DataFrame:
    """The rows of one kind; its folder is missing if there are none."""
    if n:
        return spark.read.schema(schema).parquet(f"{directory}/rejected={rejected}")
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def ingest_sources(
    competitions: DataFrame, results: DataFrame, persons: DataFrame, directory: str, person_key: str = "person_id"
) -> tuple[Sources, dict[str, Checked]]:
    """Sources of the rows that conform, and what became of each table below ``directory``."""
    checked = {
        "competitions": ingest(competitions, f"{directory}/competitions", COMPETITIONS, required=REQUIRED_OF_COMPETITIONS),
        "results": ingest(results, f"{directory}/results", RESULTS),
        "persons": ingest(persons, f"{directory}/persons", PERSONS, {person_key: "person_id"}, REQUIRED_OF_PERSONS),
    }
    events = checked["competitions"].accepted
    if "start_date" not in competitions.columns:
        events = events.withColumn("start_date", date_from_parts(F.col("year"), F.col("month"), F.col("day"), lenient=True))
    return Sources(events, checked["results"].accepted, checked["persons"].accepted), checked


def read_checked_tables(
    spark: SparkSession,
    competitions: str,
    results: str,
    persons: str,
    directory: str,
    format: str = "tsv",
    person_key: str = "person_id",
    multi_line: bool = False,
) -> tuple[Sources, dict[str, Checked]]:
    """As ``read_tables``, with bad rows and malformed lines set aside below ``directory``."""

    def read(path: str) -> DataFrame:
        if format in ("tsv", "csv"):
            return read_delimited(spark, path, "\t" if format == "tsv" else ",", multi_line=multi_line, corrupt=CORRUPT)
        return spark.read.format(format).load(path)

    return ingest_sources(read(competitions), read(results), read(persons), directory, person_key)


def rejection_report(checked: Mapping[str, Checked]) -> DataFrame:
    """(table, reason, n): rows accepted and rejected per table, and rejected rows per reason."""
    parts = []
    for name, table in checked.items():
        kinds = table.accepted.select(F.lit("accepted").alias("reason")).unionByName(
            table.rejected.select(F.explode(F.array_append("reasons", F.lit("rejected"))).alias("reason"))
        )
        parts.append(kinds.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "reason", "n"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
