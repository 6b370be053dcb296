"""The whole analysis as one job: ``spark-submit turnout/job.py --help``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import SparkSession

from turnout.operators.attendance import AttendanceModel, build_attendance
from turnout.plans import bundle
from turnout.plans.travel import year_map
from turnout.session import configure
from turnout.sources.tables import Sources, read_tables


def _positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("must be a positive integer")
    return value


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Attendance reports of one country as tables.")
    parser.add_argument("--competitions", required=True, help="path of the events table")
    parser.add_argument("--results", required=True, help="path of the results table")
    parser.add_argument("--persons", required=True, help="path of the persons table")
    parser.add_argument("--format", default="tsv", help="tsv, csv, parquet, orc, ...")
    parser.add_argument("--person-key", default="person_id", help="id column of the persons table")
    parser.add_argument("--country", required=True)
    parser.add_argument("--output", required=True, help="directory for the result tables")
    parser.add_argument("--last", type=_positive, help="the last N years only; default: all history and the last 5 years")
    parser.add_argument(
        "--versions", action="store_true", help="publish all tables at once as the next version of the output directory"
    )
    parser.add_argument("--year", type=int, help="year of the map and of the returning-newcomers report")
    return parser.parse_args(argv)


def run(spark: SparkSession, options: argparse.Namespace) -> list[str]:
    """Write every report asked for and return the paths.

    With ``--versions`` readers go on with the version before until the last table is written.
    """
    sources = read_tables(
        configure(spark), options.competitions, options.results, options.persons,
        format=options.format, person_key=options.person_key,
    )
    model = bundle.without_first_event(build_attendance(sources, options.country))
    kept = [model.competitions, model.attendance]
    for df in kept:
        df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if not options.versions:
            return [path for path, _ in _write(sources, model, options, options.output)]
        version = bundle.publish_bundle(
            spark, options.output, lambda folder: _write(sources, model, options, folder)
        )
        return [f"{options.output}/{folders[0]}" for table in version.tables.values() for folders in table.parts.values()]
    finally:
        for df in kept:
            df.unpersist()


def _write(
    sources: Sources, model: AttendanceModel, options: argparse.Namespace, output: str
) -> list[tuple[str, str]]:
    """Path and title of every table of the model, which is computed once for all of them."""
    periods = bundle.summary.PERIODS if options.last is None else (options.last,)
    written = bundle.write_bundle(model, output, periods)
    for years in periods:
        written.append((bundle.write_cohort_summary(model, output, years), "Cohort retention"))
        written.append((bundle.write_series_matrix(model, output, years), "Recurring series by year"))
    if options.year is not None:
        map_ = year_map(sources, options.year, options.country)
        written += bundle.write_year_map(map_, output)
        path = bundle.write_returning_newcomers(sources, output, options.year, options.country)
        written.append((path, "Newcomers who came back"))
    return written


def main(argv: Sequence[str] | None = None) -> None:
    options = arguments(argv)
    spark = SparkSession.builder.appName("attendance reports").getOrCreate()
    for path in run(spark, options):
        print(path)


if __name__ == "__main__":
    main()
