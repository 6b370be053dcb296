"""Sets of tables that change as one: staged in a folder of their own, current once a manifest names them.

A directory holds data folders and numbered manifests. A writer stages its files in a new data folder
and writes the next manifest last, by a rename. Readers take the highest manifest, so a run that fails
half-way leaves the tables of the run before as they were. A manifest lists the files of a table part
by part, so a version that changes few parts repeats the paths of the others instead of their rows.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = re.compile(r"manifest-(\d{10})\.json")
_DATA = re.compile(r"data-[0-9a-f]{32}")
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "enforceSchema": False}


@dataclass(frozen=True)
class Table:
    """``parts`` lists the folders of each part, relative to the directory."""

    schema: T.StructType
    parts: Mapping[str, tuple[str, ...]]
    format: str = "parquet"
    title: str = ""

    def with_parts(self, parts: Mapping[str, Iterable[str]], append: bool = False) -> Table:
        """The table with some parts replaced, or longer by the given folders."""
        new = dict(self.parts)
        for key, folders in parts.items():
            new[key] = (*new.get(key, ()), *folders) if append else tuple(folders)
        return replace(self, parts=new)


@dataclass(frozen=True)
class Version:
    number: int
    tables: Mapping[str, Table]
    settings: Mapping[str, object] = field(default_factory=dict)


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it wants it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, directory: str) -> list[str]:
    files, path = _files(spark, directory)
    if not files.exists(path):
        return []
    return [status.getPath().getName() for status in files.listStatus(path)]


def new_folder() -> str:
    """The name of a data folder that no other run has."""
    return f"data-{uuid.uuid4().hex}"


def numbers(spark: SparkSession, directory: str) -> list[int]:
    """The published versions, oldest first."""
    found = (_MANIFEST.fullmatch(name) for name in _names(spark, directory))
    return sorted(int(match[1]) for match in found if match)


def current(spark: SparkSession, directory: str, number: int | None = None) -> Version | None:
    """The latest published version, or the one asked for; None if nothing was published yet."""
    known = numbers(spark, directory)
    if number is None and not known:
        return None
    number = known[-1] if number is None else number
    files, path = _files(spark, f"{directory}/manifest-{number:010d}.json")
    stream = files.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    manifest = json.loads(text)
    tables = {
        name: Table(
            T.StructType.fromJson(entry["schema"]),
            {key: tuple(folders) for key, folders in entry["parts"].items()},
            entry["format"],
            entry["title"],
        )
        for name, entry in manifest["tables"].items()
    }
    return Version(number, tables, manifest["settings"])


def publish(spark: SparkSession, directory: str, version: Version) -> Version:
    """Make a version the current one. Its number must be new: of two writers at once, one fails."""
    text = json.dumps(
        {
            "settings": dict(version.settings),
            "tables": {
                name: {
                    "schema": table.schema.jsonValue(),
                    "parts": {key: list(folders) for key, folders in table.parts.items()},
                    "format": table.format,
                    "title": table.title,
                }
                for name, table in version.tables.items()
            },
        }
    )
    target = f"{directory}/manifest-{version.number:010d}.json"
    files, path = _files(spark, target)
    _, draft = _files(spark, f"{directory}/.draft-{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if files.exists(path) or not files.rename(draft, path):
        files.delete(draft, False)
        raise RuntimeError(f"version {version.number} of {directory} was published by another run")
    return version


def stage(df: DataFrame, directory: str, folder: str, part: str | None = None) -> Table:
    """Write ``df`` below a data folder; ``part`` is a column whose values become the table's parts.

    The rows keep the column. They are dealt out by it first, so that a part has few files; adaptive
    execution merges small parts into one task and splits a large one.
    """
    spark = df.sparkSession
    path = f"{directory}/{folder}"
    if part is None:
        df.write.parquet(path)
        return Table(df.schema, {"": (folder,)})
    df.withColumn("_part", F.col(part)).hint("rebalance", "_part").write.partitionBy("_part").parquet(path)
    folders = [name for name in _names(spark, path) if name.startswith("_part=")]
    return Table(df.schema, {name.removeprefix("_part="): (f"{folder}/{name}",) for name in folders})


def read_part(spark: SparkSession, directory: str, table: Table, parts: Iterable[object] | None = None) -> DataFrame:
    """The rows of a table, or of some of its parts; files of other parts are not even listed."""
    keys = table.parts if parts is None else [str(p) for p in parts]
    paths = [f"{directory}/{folder}" for key in keys for folder in table.parts.get(key, ())]
    if not paths:
        empty = (F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema)
        return spark.range(0).select(*empty)
    options = CSV_OPTIONS if table.format == "csv" else {}
    return spark.read.schema(table.schema).options(**options).format(table.format).load(paths)


def read(spark: SparkSession, directory: str, name: str, number: int | None = None) -> DataFrame:
    """A table of the current version, or of the one asked for."""
    version = current(spark, directory, number)
    if version is None or name not in version.tables:
        raise ValueError(f"no table {name!r} was published in {directory}")
    return read_part(spark, directory, version.tables[name])


def forget(spark: SparkSession, directory: str, keep: int = 2) -> list[str]:
    """Delete all but the last ``keep`` versions, and data that no version names any more.

    Not while a writer is at work, whose staged data no manifest names yet.
    """
    if keep < 1:
        raise ValueError(f"at least one version stays, got keep={keep!r}")
    known = numbers(spark, directory)
    kept = [current(spark, directory, n) for n in known[-keep:]]
    used = {
        folder.split("/")[0] for v in kept for t in v.tables.values() for folders in t.parts.values() for folder in folders
    }
    old = [f"manifest-{n:010d}.json" for n in known[:-keep]]
    unused = [name for name in _names(spark, directory) if _DATA.fullmatch(name) and name not in used]
    for name in (*old, *unused):
        files, path = _files(spark, f"{directory}/{name}")
        files.delete(path, True)
    return [*old, *unused]
