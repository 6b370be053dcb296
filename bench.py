"""Seconds per registered query at one scale factor; prints one JSON line.

The reports share one workspace, as a user running them all would: ``load_model`` is the time to
compute the attendance model once, and ``value`` is that plus every report. Each query is timed
from the call that builds it to the last row of a sink that takes all rows. ``independent`` times
a few reports on their own, straight from the parquet files with nothing kept. Every report runs
once on the smallest tables first, so that compiling code is not what is measured.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from turnout import build_attendance
from turnout.plans import activity, attraction, catalogue, newcomers, recurring, trends
from turnout.sources.star_schema import star_schema_sources

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
INDEPENDENT = {
    "q01_comps_per_quarter": trends.competitions_per_quarter,
    "q06_new_vs_returning": activity.new_vs_returning,
    "q13_cohort_retention": newcomers.retention,
    "q16_series_heatmap": recurring.series_heatmap,
    "q18_top_by_newcomers": attraction.top_by_newcomers,
}


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="turnout-bench-", dir="/tmp"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def warm_up(spark: SparkSession) -> None:
    """Run every report once on the smallest tables, as code of a long-lived cluster is warm."""
    smallest = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    if os.path.isdir(smallest):
        for query in catalogue.REPORTS.values():
            drain(query(spark, smallest))
        catalogue.close_workspace(spark)


def main() -> None:
    spark = session()
    warm_up(spark)

    def load() -> None:
        model = catalogue.workspace(spark, SF_DIR).model
        drain(model.attendance)  # computes the events it is joined to along the way
        drain(model.competitions)

    queries = {"load_model": timed(load)}
    for name, query in catalogue.REPORTS.items():
        queries[name] = timed(lambda query=query: drain(query(spark, SF_DIR)))

    catalogue.close_workspace(spark)

    def alone(plan) -> None:
        drain(plan(build_attendance(star_schema_sources(spark, SF_DIR), catalogue.COUNTRY)))

    independent = {name: timed(lambda plan=plan: alone(plan)) for name, plan in INDEPENDENT.items()}

    print(
        json.dumps(
            {
                "metric": "all_reports_total",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
                "independent": independent,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
