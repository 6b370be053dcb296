"""The three source tables and how to read them.

``competitions``, ``results`` and ``persons`` may come from delimited files, parquet, a database
table or any DataFrame. Every reader ends in :func:`conform`, which picks columns by name, casts
them to the declared types and drops rows without a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnout.functions.dates import date_from_parts
from turnout.functions.text import empty_to_null

COMPETITIONS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("name", T.StringType()),
        T.StructField("cell_name", T.StringType()),
        T.StructField("city_name", T.StringType()),
        T.StructField("country_id", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
        T.StructField("cancelled", T.IntegerType()),
        T.StructField("latitude_microdegrees", T.LongType()),
        T.StructField("longitude_microdegrees", T.LongType()),
        T.StructField("event_specs", T.StringType()),
    ]
)
RESULTS = T.StructType(
    [
        T.StructField("competition_id", T.StringType(), False),
        T.StructField("person_id", T.StringType(), False),
        T.StructField("person_country_id", T.StringType()),
    ]
)
PERSONS = T.StructType(
    [
        T.StructField("person_id", T.StringType(), False),
        T.StructField("sub_id", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("country_id", T.StringType()),
    ]
)


# Columns without which every report would be empty; the others may be absent and are null then.
# Two dates are special: start_date follows from year, month and day, and a missing end_date stays
# missing, so that the one report that needs it can say so.
REQUIRED_OF_COMPETITIONS = ("country_id", "year", "month", "day", "cancelled")
REQUIRED_OF_PERSONS = ("sub_id", "country_id")
LEFT_OUT_IF_MISSING = ("end_date",)


@dataclass(frozen=True)
class Sources:
    """The raw tables: all countries, all years, cancelled events included."""

    competitions: DataFrame
    results: DataFrame
    persons: DataFrame


def conform(
    df: DataFrame,
    schema: T.StructType,
    rename: Mapping[str, str] | None = None,
    required: Sequence[str] = (),
) -> DataFrame:
    """Columns of ``schema`` by name, cast, empty text as null; rows with a null key are dropped.

    ``rename`` maps a column of ``df`` to its name in the schema. A nullable column that ``df``
    lacks becomes null; a missing key or ``required`` column is an error.
    """
    for source, target in (rename or {}).items():
        if source in df.columns:
            df = df.withColumnRenamed(source, target)
    picked = []
    for field in schema:
        if field.name in df.columns:
            column = F.col(field.name)
            if isinstance(df.schema[field.name].dataType, T.StringType):
                column = empty_to_null(column)
        elif not field.nullable:
            raise ValueError(f"missing key column {field.name!r}; found {df.columns}")
        elif field.name in required:
            raise ValueError(f"missing column {field.name!r}; found {df.columns}")
        elif field.name in LEFT_OUT_IF_MISSING:
            continue
        else:
            column = F.lit(None)
        picked.append(column.cast(field.dataType).alias(field.name))
    keys = [field.name for field in schema if not field.nullable]
    return df.select(*picked).dropna(subset=keys)


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str = "\t",
    null_value: str = "NULL",
    multi_line: bool = False,
    corrupt: str | None = None,
) -> DataFrame:
    """Delimited text with a header line; every column is text, quotes are doubled inside quotes.

    Nothing is inferred, so the files are scanned once, and they stay splittable unless quoted
    fields hold line breaks (``multi_line``). Lines with too few or too many fields are read as far
    as they go; a column named by ``corrupt`` holds them.
    """
    options = {
        "sep": sep, "header": True, "nullValue": null_value, "quote": '"', "escape": '"', "multiLine": multi_line,
    }
    first = spark.read.options(**options).csv(path).schema
    if corrupt is not None:
        first = T.StructType([*first, T.StructField(corrupt, T.StringType())])
        options["columnNameOfCorruptRecord"] = corrupt
    # The header of every file is compared with the first one's: files of another order are an error.
    return spark.read.options(**options, enforceSchema=False).schema(first).csv(path)


def sources_from(
    competitions: DataFrame,
    results: DataFrame,
    persons: DataFrame,
    person_key: str = "person_id",
) -> Sources:
    """Sources from any three DataFrames; ``person_key`` is the id column of ``persons``."""
    events = conform(competitions, COMPETITIONS, required=REQUIRED_OF_COMPETITIONS)
    if "start_date" not in competitions.columns:
        events = events.withColumn("start_date", date_from_parts(F.col("year"), F.col("month"), F.col("day"), lenient=True))
    return Sources(
        events,
        conform(results, RESULTS),
        conform(persons, PERSONS, rename={person_key: "person_id"}, required=REQUIRED_OF_PERSONS),
    )


def read_tables(
    spark: SparkSession,
    competitions: str,
    results: str,
    persons: str,
    format: str = "tsv",
    person_key: str = "person_id",
    multi_line: bool = False,
) -> Sources:
    """Sources from three paths: ``tsv`` and ``csv`` text, or any format Spark reads by path."""

    def read(path: str) -> DataFrame:
        if format in ("tsv", "csv"):
            return read_delimited(spark, path, "\t" if format == "tsv" else ",", multi_line=multi_line)
        return spark.read.format(format).load(path)

    return sources_from(read(competitions), read(results), read(persons), person_key)


def read_database(
    spark: SparkSession,
    url: str,
    competitions: str = "competitions",
    results: str = "results",
    persons: str = "persons",
    person_key: str = "person_id",
    results_split: tuple[str, str, str, int] | None = None,
    **options: str,
) -> Sources:
    """Sources from database tables over JDBC (the driver jar has to be on the class path).

    ``results_split`` = (numeric or date column, lower, upper, partitions) reads the large table
    in parallel instead of through one connection.
    """

    def read(table: str, split: tuple[str, str, str, int] | None = None) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
        if split is not None:
            column, lower, upper, partitions = split
            reader = reader.options(
                partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=str(partitions)
            )
        return reader.load()

    return sources_from(read(competitions), read(results, results_split), read(persons), person_key)
