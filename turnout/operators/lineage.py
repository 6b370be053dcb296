"""Cutting the lineage of iterative jobs through the cluster's shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir`` unless the session has one set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    directory = spark.conf.get("spark.checkpoint.dir", None)
    if directory is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(directory)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, for tables that a job writes and reads again."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored, so that a lost executor costs a read, not the whole loop.

    Spark deletes the files with the result if ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set when the session starts.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
