"""What the plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from tests.conftest import DATA
from turnout import build_attendance
from turnout.plans import activity, attraction, catalogue, newcomers, recurring, summary, trends
from turnout.sources.star_schema import star_schema_sources

SF = f"{DATA}/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow", "PythonUDF")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def model(spark):
    """Not persisted, so that the plans reach down to the scans."""
    catalogue.close_workspace(spark)
    return build_attendance(star_schema_sources(spark, SF), "AMERICA")


@pytest.mark.parametrize("name", sorted(catalogue.all_queries()))
def test_no_nested_loops_and_no_python(spark, name):
    plan = plan_of(catalogue.all_queries()[name](spark, SF))
    assert not [word for word in FORBIDDEN if word in plan]


def test_scans_read_only_what_is_used(spark, model):
    plan = plan_of(trends.competitions_per_quarter(model))
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert "l_suppkey:bigint,l_shipdate:timestamp_ntz" in read
    assert not any("p_type" in columns or "o_orderkey" in columns for columns in read)


def test_unused_columns_cost_no_join(spark, model):
    plan = plan_of(activity.new_vs_returning(model))
    assert "p_type" not in plan and "c_custkey" not in plan


def test_country_filter_reaches_the_scan(spark, model):
    assert "EqualTo(r_name,AMERICA)" in plan_of(trends.competitions_per_quarter(model))


def test_pairs_are_shuffled_once(spark, model):
    model.attendance.collect()
    df = activity.new_vs_returning(model)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert re.search(r"ReusedExchange \[competition_id#\d+, person_id#\d+\]", final)


@pytest.mark.parametrize("plan", [attraction.top_by_newcomers, attraction.top_by_share, recurring.series_trend])
def test_top_lists_do_not_sort_everything(model, plan):
    assert "TakeOrderedAndProject" in plan_of(plan(model))


@pytest.mark.parametrize("plan", [newcomers.retention, newcomers.return_distribution])
def test_retention_is_aggregated_without_a_second_join(model, plan):
    """One row per person straight from the attendance rows: debuts are not joined back."""
    whole, base = optimized(plan(model)).count("Join "), optimized(model.attendance).count("Join ")
    assert whole <= base


def test_no_distinct_expansion(model):
    for plan in (activity.new_vs_returning, newcomers.retention, activity.consistently_active):
        assert "Expand" not in plan_of(plan(model))


def test_windows_without_partition_follow_a_bound(model):
    """Unpartitioned windows run on top lists, on calendar quarters, or on drawn cells only."""
    for plan in (
        trends.competitions_per_quarter, trends.attendance_per_quarter, activity.unique_competitors,
        activity.new_vs_returning, activity.starts_histogram, activity.activity_trend,
        newcomers.debuts_per_quarter, newcomers.return_distribution, attraction.by_calendar_month,
        summary.period_summary,
    ):
        assert "Window" not in plan_of(plan(model))
