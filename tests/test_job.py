"""The job from text files to result tables."""

from __future__ import annotations

import os

import pytest

from tests.test_sources import COMPETITION_LINES, PERSON_LINES, RESULT_LINES, write_lines
from tests.tiny import rows
from turnout import job


@pytest.fixture
def options(folder):
    paths = {
        "competitions": write_lines(folder, "competitions.tsv", COMPETITION_LINES),
        "results": write_lines(folder, "results.tsv", RESULT_LINES),
        "persons": write_lines(folder, "persons.tsv", PERSON_LINES),
    }
    common = [part for name, path in paths.items() for part in (f"--{name}", path)]
    common += ["--person-key", "key", "--country", "Home", "--output", f"{folder}/out"]
    return lambda *more: job.arguments([*common, *more])


def test_last_year_and_map(spark, folder, options):
    paths = job.run(spark, options("--last", "1", "--year", "2020"))
    assert len(paths) == len(set(paths)) and all(os.path.exists(f"{p}/_SUCCESS") for p in paths)
    out = f"{folder}/out"
    assert rows(spark.read.parquet(f"{out}/01_comps_per_quarter_last1y")) == [(2021, 1, "2021 Q1", 1)]
    assert rows(spark.read.parquet(f"{out}/map_density_all"), "competition_id", "n") == [("A1", 1)]
    assert rows(spark.read.parquet(f"{out}/map_summary")) == [(1, 1, 1, 1, 1)]
    report = spark.read.option("header", True).csv(f"{out}/returning_newcomers_2020")
    assert report.columns == ["competition_id", "competition_name", "newcomers", "returned_newcomers"]


@pytest.mark.parametrize("last", ["0", "-3", "x"])
def test_last_is_checked(options, last):
    with pytest.raises(SystemExit):
        options("--last", last)
