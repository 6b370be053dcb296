"""An attendance model written once and read by later sessions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from turnout.operators.attendance import AttendanceModel

TABLES = ("competitions", "attendance", "persons", "first_dates")
BY_YEAR = ("competitions", "attendance")


def write_model(model: AttendanceModel, directory: str) -> None:
    """Write the four tables as parquet, events and attendance in one folder per year.

    Rows are dealt out by year first; adaptive execution then merges small years into one task and
    splits a crowded one, so files have about the advised size, whatever the number of partitions.
    """
    for name in TABLES:
        table = getattr(model, name)
        if name in BY_YEAR:
            table.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(f"{directory}/{name}")
        else:
            table.write.mode("overwrite").parquet(f"{directory}/{name}")


def read_model(spark: SparkSession, directory: str) -> AttendanceModel:
    """The written model; a period restriction then reads only the folders of its years."""
    return AttendanceModel(**{name: spark.read.parquet(f"{directory}/{name}") for name in TABLES})
