"""Reports by person from buckets: the same rows, and no shuffle of rows by person."""

from __future__ import annotations

import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.test_skew import CROWD, EVENTS, NO_BROADCAST, model, settings  # noqa: F401
from tests.tiny import competition, rows, sources
from turnout import build_attendance, last_years
from turnout.operators.cohorts import debuts, followups, return_counts
from turnout.plans import activity, newcomers
from turnout.sources import versions
from turnout.sources.person_store import person_days, read_person_store, write_person_store

BY_PERSON = [
    newcomers.retention, newcomers.return_distribution, newcomers.debuts_per_quarter, newcomers.debuts_per_month,
    activity.unique_competitors, activity.new_vs_returning, activity.newcomer_share, activity.starts_histogram,
    activity.consistently_active, activity.activity_trend,
]


def tiny_model(spark):
    events = [
        competition("a", "2019-01-05"), competition("b", "2019-01-05"), competition("c", "2019-03-09"),
        competition("d", "2020-06-01"), competition("e", "2021-12-31"),
    ]
    starts = [
        ("a", "two-at-once"), ("b", "two-at-once"), ("c", "two-at-once"), ("a", "once"), ("e", "late"),
        ("a", "often"), ("c", "often"), ("d", "often"), ("e", "often"), ("d", "o'brien"), ("e", "o'brien"),
    ]
    return build_attendance(sources(spark, events, starts), "Home")


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled_by(df):
    """The key lists of all exchanges of the plan."""
    return [re.sub(r"#\d+", "", keys) for keys in re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", executed(df))]


@pytest.fixture
def stored(spark, folder):
    write_person_store(tiny_model(spark), folder, buckets=4)
    return read_person_store(spark, folder)


def test_days_of_persons(spark, stored):
    days = {(r.person_id, str(r.date)): (r.is_newcomer, r.n_starts, r.year, r.quarter) for r in stored.person_days.collect()}
    assert days["two-at-once", "2019-01-05"] == (True, 2, 2019, 1)
    assert days["often", "2020-06-01"] == (False, 1, 2020, 2)
    assert len(days) == 10 and sum(n for _, n, _, _ in days.values()) == 11
    assert rows(stored.person_days) == rows(person_days(tiny_model(spark).attendance), *stored.person_days.columns)


@pytest.mark.parametrize("years", [None, 1, 2])
@pytest.mark.parametrize("plan", BY_PERSON)
def test_stored_reports_equal_those_of_the_rows(spark, stored, plan, years):
    assert rows(plan(last_years(stored, years))) == rows(plan(last_years(tiny_model(spark), years)))


def test_stored_tables_equal_the_model(spark, stored):
    model_ = tiny_model(spark)
    for name in ("competitions", "attendance", "persons", "first_dates"):
        columns = getattr(model_, name).columns
        assert rows(getattr(stored, name), *columns) == rows(getattr(model_, name), *columns)
    assert rows(debuts(stored.person_days)) == rows(debuts(model_.attendance))
    assert rows(return_counts(stored.person_days)) == rows(return_counts(model_.attendance))
    assert rows(followups(stored.attendance, stored.person_days)) == rows(followups(model_.attendance))


@pytest.mark.parametrize("plan", BY_PERSON)
def test_reports_do_not_shuffle_by_person(stored, plan):
    """What is shuffled has been reduced to quarters, years or numbers of starts first."""
    assert not [keys for keys in shuffled_by(plan(stored)) if "person_id" in keys]
    assert "Bucketed: true" in executed(plan(stored))


def test_followups_leave_attendance_where_it_is(settings, stored):  # noqa: F811
    """Only days of newcomers move, to the rows' buckets; the rows do not."""
    settings(NO_BROADCAST)
    df = followups(stored.attendance, stored.person_days)
    assert shuffled_by(df) == ["person_id, date"]
    assert "competition_id" not in executed(df).split("Exchange hashpartitioning")[-1].split("FileScan")[1]


def test_another_session_reads_the_buckets(spark, folder):
    """The catalog entry is made from the manifest, so a session that never wrote has it as well."""
    write_person_store(tiny_model(spark), folder, buckets=3)
    other = spark.newSession()
    for table in spark.catalog.listTables():
        if table.name.startswith("turnout_"):
            spark.sql(f"DROP TABLE {table.name}")
    again = read_person_store(other, folder)
    assert again.person_days.count() == 10
    assert not [keys for keys in shuffled_by(newcomers.retention(again)) if "person_id" in keys]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("turnout_draft")]


def test_a_new_version_replaces_the_old_whole(spark, folder, monkeypatch):
    model_ = tiny_model(spark)
    write_person_store(model_, folder, buckets=2)
    write_person_store(last_years(model_, 1), folder, buckets=5)
    assert read_person_store(spark, folder).person_days.count() == 3
    monkeypatch.setattr(versions, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        write_person_store(model_, folder, buckets=2)
    assert read_person_store(spark, folder).person_days.count() == 3


def test_buckets_are_sorted_by_day(spark, folder, model):  # noqa: F811
    """A period's rows lie together in every bucket, and the comparison by year reaches the files."""
    write_person_store(model, folder, buckets=4)
    stored = read_person_store(spark, folder)
    for table in (stored.attendance, stored.person_days):
        files = [r[0].removeprefix("file://") for r in table.select(F.input_file_name()).distinct().collect()]
        assert len(files) == 4
        days = [pq.read_table(file, columns=["date"])["date"].to_pylist() for file in files]
        assert all(d == sorted(d) for d in days)
        assert max(len(set(d)) for d in days) > 50  # the crowd starts on one day, the busy person on 420
    plan = executed(newcomers.retention(last_years(stored, 2)))
    assert re.search(r"DataFilters: \[[^\]]*year#\d+ >= ", plan)


def test_nothing_stored(spark, folder):
    with pytest.raises(ValueError):
        read_person_store(spark, folder)
    empty = build_attendance(sources(spark, [competition("a", "2019-01-05")], [("a", "x")]), "Elsewhere")
    write_person_store(empty, folder, buckets=2)
    stored = read_person_store(spark, folder)
    assert stored.person_days.count() == 0 and newcomers.retention(stored).count() == 0


def test_a_busy_person_fills_no_bucket(spark, folder, model):  # noqa: F811
    """Half of the rows are one person's: their days are few, and their rows are spread by day."""
    write_person_store(model, folder, buckets=16)
    stored = read_person_store(spark, folder)
    assert stored.person_days.where("person_id = 'busy'").count() <= 366 * 5
    for table, total in ((stored.attendance, EVENTS + CROWD), (stored.person_days, stored.person_days.count())):
        sizes = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
        assert sum(sizes) == total and max(sizes) < total / 3
    returns = {r.returns: r.n_persons for r in newcomers.return_distribution(stored).collect()}
    whole = {r.returns: r.n_persons for r in newcomers.return_distribution(model).collect()}
    assert returns == whole and sum(returns.values()) == CROWD + 1
