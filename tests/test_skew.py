"""A person and an event that hold most of the rows."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from turnout import Sources, build_attendance
from turnout.operators.cohorts import followups
from turnout.plans import activity, attraction, newcomers

EVENTS = 20000
CROWD = 20000

NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}
# Partitions count as hot from a few kilobytes on.
TIGHT = NO_BROADCAST | {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def settings(spark):
    before = {}

    def apply(values):
        for key, value in values.items():
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield apply
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def model(spark):
    """One person starts at every event, and one event has everybody."""
    events = spark.range(EVENTS).selectExpr(
        "concat('c', id) as id", "concat('Open ', id) as name", "'Cell' as cell_name", "'Town' as city_name",
        "'Home' as country_id", "cast(2010 + id % 5 as int) as year", "cast(1 + id % 12 as int) as month",
        "cast(1 + id % 28 as int) as day", "0 as cancelled", "cast(50000000 as bigint) as latitude_microdegrees",
        "cast(20000000 as bigint) as longitude_microdegrees", "'333' as event_specs",
    )
    busy = spark.range(EVENTS).selectExpr("concat('c', id) as competition_id", "'busy' as person_id")
    crowd = spark.range(CROWD).selectExpr("'c0' as competition_id", "concat('p', id) as person_id")
    results = busy.unionByName(crowd).unionByName(busy)
    persons = results.select(
        "person_id", F.lit(1).alias("sub_id"), F.lit("N").alias("name"), F.lit("Home").alias("country_id")
    ).distinct()
    return build_attendance(Sources(events, results, persons), "Home")


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def largest_share(df, column):
    """The part of the rows that the fullest task of the stage has which makes the column."""
    tasks = {}
    for r in df.groupBy(column, F.spark_partition_id().alias("task")).count().collect():
        tasks[r.task] = tasks.get(r.task, 0) + r["count"]
    return max(tasks.values()) / sum(tasks.values())


def test_busy_person_is_spread_over_tasks(settings, model):
    """Half of the rows are one person's, and no task of the joins by person gets a third."""
    settings(NO_BROADCAST | {"spark.sql.adaptive.enabled": "false"})
    assert largest_share(model.attendance, "is_newcomer") < 1 / 3
    assert largest_share(model.attendance, "first_comp_date") < 1 / 3
    assert largest_share(followups(model.attendance), "days_after") < 1 / 3


def test_rows_are_never_joined_by_person_alone(settings, model):
    settings(NO_BROADCAST)
    plan = model.attendance.select("competition_id", "person_id", "is_newcomer")
    joins = re.findall(r"(?:SortMerge|ShuffledHash)Join \[([^\]]*)\]", plan._jdf.queryExecution().executedPlan().toString())
    keys = {re.sub(r"#\d+", "", key) for key in joins}
    assert keys == {"person_id, date", "competition_id"}


def test_crowded_event_is_split(settings, model):
    settings(TIGHT)
    stats = attraction.top_by_newcomers(model, limit=1)
    top = stats.first()
    assert (top.competition_id, top.newcomers) == ("c0", CROWD + 1)
    df = model.attendance.select("person_id", "is_newcomer")
    assert len(df.collect()) == EVENTS + CROWD
    assert "skew=true" in final_plan(df)


def test_results_are_whole(settings, model):
    settings(TIGHT)
    returns = {r.returns: r.n_persons for r in newcomers.return_distribution(model).collect()}
    # Everybody at c0 debuts there; the busy person starts on every other day as well.
    assert returns[0] == CROWD and returns[max(returns)] == 1 and sum(returns.values()) == CROWD + 1
    assert max(returns) > 25
    quarters = activity.unique_competitors(model)
    assert quarters.agg(F.max("n")).first()[0] == CROWD + 1
    histogram = {(r.year, r.n_comps): r.n_persons for r in activity.starts_histogram(model).collect()}
    # The busy person starts 4,000 times in each of the five years; every number up to it has a row.
    assert histogram[(2010, 1)] == CROWD and histogram[(2010, 20)] == 0
    assert histogram[(2010, 4000)] == 1 and histogram[(2011, 4000)] == 1
