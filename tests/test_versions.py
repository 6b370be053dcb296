"""Bundles that change as one: failures, readers, old versions, and the job's switch."""

from __future__ import annotations

import os

import pytest

from tests.test_job import options  # noqa: F401
from tests.tiny import HOME, competition, rows, sources
from turnout import build_attendance, job
from turnout.plans import bundle
from turnout.sources import versions

CHARTS = bundle.CHARTS[:3]


def model(spark, n):
    events = [competition(f"c{k}", f"{2015 + k}-02-01") for k in range(n)]
    return build_attendance(sources(spark, events, [(e[0], "p") for e in events]), HOME)


def publish(spark, folder, n, charts=CHARTS, **more):
    return bundle.publish_bundle(spark, folder, lambda to: bundle.write_bundle(model(spark, n), to, (None, 2), charts), **more)


def test_readers_follow_the_manifest(spark, folder):
    version = publish(spark, folder, 3)
    assert version.number == 1 and len(version.tables) == 2 * (len(CHARTS) + 1) + 1
    assert bundle.read_bundle(spark, folder, "01_comps_per_quarter_all").count() == 3
    assert bundle.read_bundle(spark, folder, "01_comps_per_quarter_last2y").count() == 2
    assert versions.current(spark, folder).tables["03_comps_ytd_all"].title == "Events year to date"
    opened = bundle.read_bundle(spark, folder, "01_comps_per_quarter_all")
    publish(spark, folder, 4)
    assert bundle.read_bundle(spark, folder, "01_comps_per_quarter_all").count() == 4
    assert opened.count() == 3  # whoever reads the version before goes on with it
    assert bundle.read_bundle(spark, folder, "01_comps_per_quarter_all", 1).count() == 3
    publish(spark, folder, 5, keep=1)
    assert versions.numbers(spark, folder) == [3] and len([n for n in os.listdir(folder) if n.startswith("data-")]) == 1


def test_a_run_that_fails_leaves_the_bundle_readable(spark, folder):
    publish(spark, folder, 3)

    def broken(_):
        raise RuntimeError("executor lost for good")

    charts = (*CHARTS, ("99_broken", "Broken", broken))
    with pytest.raises(RuntimeError):
        publish(spark, folder, 5, charts)
    assert versions.numbers(spark, folder) == [1]
    for name, _, _ in CHARTS:
        bundle.read_bundle(spark, folder, f"{name}_all").collect()
    assert bundle.read_bundle(spark, folder, "01_comps_per_quarter_all").count() == 3
    # A draft of a manifest is no version, and the next run clears what the failed one left.
    publish(spark, folder, 4, keep=1)
    assert len([n for n in os.listdir(folder) if n.startswith("data-")]) == 1


def test_the_job_publishes_all_tables_at_once(spark, folder, options):  # noqa: F811
    paths = job.run(spark, options("--last", "1", "--year", "2020", "--versions"))
    out = f"{folder}/out"
    assert all(os.path.exists(f"{p}/_SUCCESS") for p in paths)
    assert rows(bundle.read_bundle(spark, out, "01_comps_per_quarter_last1y")) == [(2021, 1, "2021 Q1", 1)]
    report = bundle.read_bundle(spark, out, "returning_newcomers_2020")
    assert report.columns == ["competition_id", "competition_name", "newcomers", "returned_newcomers"]
    assert {t.format for t in versions.current(spark, out).tables.values()} == {"parquet", "csv"}
    job.run(spark, options("--last", "1", "--versions"))
    assert versions.numbers(spark, out) == [1, 2]


def test_parts_are_replaced_or_grow(spark, folder):
    first, second = versions.new_folder(), versions.new_folder()
    years = spark.createDataFrame([(y, k) for y in (2019, 2020) for k in range(3)], "year int, k int")
    table = versions.stage(years, folder, first, "year")
    assert sorted(table.parts) == ["2019", "2020"]
    more = versions.stage(years.where("year = 2020 and k = 0"), folder, second, "year")
    assert versions.read_part(spark, folder, table.with_parts(more.parts)).count() == 4
    assert versions.read_part(spark, folder, table.with_parts(more.parts, append=True)).count() == 7
    assert versions.read_part(spark, folder, table, [2019, 1999]).count() == 3
    assert versions.read_part(spark, folder, table, []).columns == ["year", "k"]
    with pytest.raises(ValueError):
        versions.forget(spark, folder, keep=0)
