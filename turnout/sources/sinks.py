"""Writers: one directory per table, rows never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, format: str = "parquet") -> str:
    """Write a result as parquet, or as ``csv`` with a header line. Returns the path."""
    writer = df.write.mode("overwrite")
    if format == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    writer.format(format).save(path)
    return path


def read_table(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet") -> DataFrame:
    """A table that :func:`write_table` wrote, with the schema it had."""
    options = {"header": True, "quote": '"', "escape": '"'} if format == "csv" else {}
    return spark.read.schema(schema).options(**options).format(format).load(path)
