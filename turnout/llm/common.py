"""What the operators share: row packing, stored intermediate tables, sizes of tasks."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space and words as the operators' contracts define them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


# Bounds of what a Python worker gets at once; long texts fill a batch by bytes, not by rows.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session. Partition counts and memory are the cluster's."""
    for key, value in ARROW_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def packed(df: DataFrame) -> DataFrame:
    """One struct column ``row`` with every column of ``df``.

    The names an operator works with cannot clash with a caller's columns then, and ``row.*`` gives
    the caller's columns back. Unused fields are still pruned from the scan.
    """
    return df.select(F.struct("*").alias("row"))


def field(name: str) -> Column:
    return F.col("row").getField(name)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(field(name), F.lit(""))


# Items of a list that is copied to append one; longer lists are lists of such parts.
LIST_PART = 256


def laid_out(
    steps: Column,
    width: Callable[[Column], Column],
    item: Callable[[Column, Column], Column],
    wanted: Callable[[Column], Column],
    item_type: str,
) -> Column:
    """``item(step, at)`` of the wanted steps, ``at`` being the widths of all steps before.

    One pass with a running sum. Appending copies a list, so items are gathered in parts of
    ``LIST_PART`` and a long array costs no square of its length.
    """
    start = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast(f"array<{item_type}>").alias("open"),
        F.array().cast(f"array<array<{item_type}>>").alias("full"),
    )

    def step(acc: Column, s: Column) -> Column:
        one, ends = F.array(item(s, acc["at"])), F.size(acc["open"]) >= LIST_PART
        grown = F.when(ends, one).otherwise(F.concat(acc["open"], one))
        closed = F.concat(acc["full"], F.array(acc["open"]))
        return F.struct(
            (acc["at"] + width(s)).alias("at"),
            F.when(wanted(s), grown).otherwise(acc["open"]).alias("open"),
            F.when(wanted(s) & ends, closed).otherwise(acc["full"]).alias("full"),
        )

    return F.aggregate(steps, start, step, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["open"]))))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see; only a local session may lack it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="turnout-llm-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read from there.

    It cuts the lineage: an executor that is lost costs a read of the table, not the work before it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """(row_id, row): the rows of ``df``, stored with a number of their own, whatever they hold or repeat.

    The numbers are written once, so they stay the same however often the table is read.
    """
    return stored(packed(df).select(F.monotonically_increasing_id().alias("row_id"), "row"), "rows")


def identity(rows: DataFrame) -> Column:
    """What orders the rows of a numbered table: doc_id, null last, then a hash of the row, then its number.

    The hash makes the order of rows that repeat a doc_id depend on what they hold, not on where they
    were read; rows that are alike in all of it may stand for each other.
    """
    names = [f.name for f in rows.schema["row"].dataType.fields if "map<" not in f.dataType.simpleString()]
    return F.struct(
        field("doc_id").isNull().alias("last"),
        field("doc_id").alias("doc_id"),
        F.xxhash64(*[field(n) for n in names]).alias("tie"),
        F.col("row_id"),
    )


def clear_stored(spark: SparkSession) -> None:
    """Delete the application's stored tables; results that still read them must be written before."""
    path = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def apart(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly, so that a join deals both its sides anew.

    Adaptive execution splits a hot key of a join only if both sides come straight from the join's
    own exchanges; an aggregate on the same key would take the place of one.
    """
    return df.hint("rebalance")


def small_table(spark: SparkSession, rows: list[list], schema: str) -> DataFrame:
    """A table of settings that the driver made, such as a ring; its size depends on parameters only."""
    names = [part.split(":")[0].strip() for part in schema.split(",") if ":" in part]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    parsed = F.from_json(F.lit(text), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(parsed))
