"""Relations between the reports that hold on any data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from turnout import build_attendance, last_years
from turnout.operators.cohorts import debuts, followups, return_counts
from turnout.operators.regions import geo_regions
from turnout.plans import activity, newcomers, trends
from turnout.plans.workspace import Workspace
from turnout.sources.star_schema import star_schema_sources


@pytest.fixture(scope="module")
def model(spark):
    m = build_attendance(star_schema_sources(spark, f"{DATA}/sf0.01"), "AMERICA")
    m.competitions.persist()
    m.attendance.persist()
    yield m
    m.attendance.unpersist()
    m.competitions.unpersist()


def total(df, column):
    return df.agg(F.sum(column).alias("s")).first().s


def by_quarter(df, *columns):
    return {(r.year, r.quarter): tuple(r[c] for c in columns) for r in df.collect()}


def test_event_counts_agree(model):
    n = model.competitions.count()
    assert total(trends.competitions_per_quarter(model), "n") == n
    assert total(trends.competitions_per_month(model), "n") == n
    assert total(trends.competitions_year_to_date(model).where("month = 12"), "n_ytd") == n


def test_newcomers_agree(model):
    new = by_quarter(activity.new_vs_returning(model), "newcomers")
    debuts = by_quarter(newcomers.debuts_per_quarter(model), "newcomers")
    assert {k: v for k, v in new.items() if v != (0,)} == debuts
    cohorts = by_quarter(newcomers.retention(model), "newcomers")
    assert cohorts == debuts
    distribution = newcomers.return_distribution(model)
    everyone = sum(n for (n,) in debuts.values())
    assert total(distribution, "n_persons") == distribution.first().n_total == everyone
    assert total(newcomers.debuts_per_month(model), "n") == everyone


def test_retention_grows_with_the_window(model):
    for r in newcomers.retention(model).collect():
        assert 0 <= r.ret_3m <= r.ret_6m <= r.ret_12m <= r.newcomers


def test_unique_is_at_most_new_plus_returning(model):
    unique = by_quarter(activity.unique_competitors(model), "n")
    split = by_quarter(activity.new_vs_returning(model), "newcomers", "returning")
    assert set(unique) == set(split)
    assert all(max(split[q]) <= unique[q][0] <= sum(split[q]) for q in unique)


def test_cohorts_of_a_period_equal_those_of_all_history(model):
    whole = by_quarter(newcomers.retention(model), "newcomers", "ret_3m", "ret_6m", "ret_12m")
    for quarter, values in by_quarter(
        newcomers.retention(last_years(model, 3)), "newcomers", "ret_3m", "ret_6m", "ret_12m"
    ).items():
        assert whole[quarter] == values


def test_histogram_holds_every_person_once_a_year(model):
    persons = model.attendance.select("person_id", "year").distinct().count()
    assert total(activity.starts_histogram(model), "n_persons") == persons
    assert total(activity.starts_histogram(model, cap=2), "n_persons") == persons


def test_outer_join_gives_the_same_split(model):
    """The two-sided form of the split: one count per kind, joined on the quarter."""
    counted = [
        model.attendance.where(F.col("is_newcomer") == kind)
        .groupBy("year", "quarter")
        .agg(F.count_distinct("person_id").alias(name))
        for kind, name in ((True, "newcomers"), (False, "returning"))
    ]
    joined = counted[0].join(counted[1], ["year", "quarter"], "full_outer").na.fill(0)
    columns = ("newcomers", "returning")
    assert by_quarter(joined, *columns) == by_quarter(activity.new_vs_returning(model), *columns)


def test_never_returned_is_a_set_difference(model):
    """Those without returns are the debutants minus the ones with a later event."""
    later = followups(model.attendance).where("days_after > 0").select("person_id").distinct()
    never = debuts(model.attendance).join(later, "person_id", "left_anti").select("person_id")
    counted = return_counts(model.attendance)
    assert never.exceptAll(counted.where("returns = 0").select("person_id")).isEmpty()
    assert never.count() == counted.where("returns = 0").count()
    both = never.withColumn("returns", F.lit(0)).unionByName(
        followups(model.attendance).where("days_after > 0").groupBy("person_id").agg(F.count("*").alias("returns"))
    )
    assert both.exceptAll(counted.select("person_id", "returns")).isEmpty()


def test_spread_is_zero_exactly_where_places_coincide(spark):
    w = Workspace(star_schema_sources(spark, f"{DATA}/sf0.01"), "AMERICA", 1998)
    places = (
        w.map.participants.join(w.map.events, "competition_id")
        .groupBy("person_id")
        .agg(F.count_distinct("lat", "lon").alias("places"))
    )
    odd = w.spread.join(places, "person_id").where((F.col("spread_km") == 0) != (F.col("places") == 1))
    assert odd.isEmpty()
    w.release()


def test_region_labels_do_not_depend_on_row_order(spark):
    w = Workspace(star_schema_sources(spark, f"{DATA}/sf0.01"), "AMERICA", 1998)
    shuffled = w.map.events.repartition(5).orderBy(F.xxhash64("competition_id"))
    assert geo_regions(shuffled).exceptAll(w.regions).isEmpty()
    w.release()
