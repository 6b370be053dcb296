"""What a query does not need is not computed, and what it needs twice is computed once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.test_ledger import EVENT, assert_same, batch, joined, ledger_of
from tests.test_plans import plan_of
from turnout import build_attendance
from turnout.plans import catalogue, recurring, trends
from turnout.plans.workspace import Workspace
from turnout.session import configure
from turnout.sources import ledger
from turnout.sources.star_schema import star_schema_sources

SF = f"{DATA}/sf0.001"


@pytest.fixture
def workspace(spark):
    catalogue.close_workspace(spark)
    shared = Workspace(star_schema_sources(spark, SF), "AMERICA", 1998)
    yield shared
    shared.release()


def test_partitions_fit_a_task(spark):
    assert configure(spark).conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16MB"


def test_reports_do_not_ask_for_what_events_offer(workspace):
    model = workspace.model
    assert "p_type" not in plan_of(model.attendance) and "p_type" not in plan_of(model.competitions.select("name"))
    assert "p_type" not in plan_of(model.event_stats.select("name", "total", "pct_newcomers"))
    assert "p_type" in plan_of(model.event_stats)


def test_series_ask_for_no_debuts(workspace):
    assert "is_newcomer" in plan_of(workspace.model.attendance)
    plan = plan_of(recurring.series_trend(workspace.model))
    assert "is_newcomer" not in plan and "p_type" not in plan
    sizes = trends.field_sizes(workspace.model).select("competition_id", "n_competitors")
    want = workspace.model.event_stats.select("competition_id", F.col("total").alias("n_competitors"))
    assert sizes.exceptAll(want).isEmpty() and want.exceptAll(sizes).isEmpty()


def test_a_map_holds_the_records_of_its_participants(workspace):
    taking_part = {r[0] for r in workspace.map.participants.select("person_id").distinct().collect()}
    held = [r[0] for r in workspace.map.persons.select("person_id").collect()]
    assert sorted(held) == sorted(taking_part)
    assert "InMemoryTableScan" in plan_of(workspace.map.persons)


def test_stored_events_are_compared_only_if_they_come_again(spark, folder, monkeypatch):
    first = batch(spark, [EVENT["a19"]], [("a19", "p"), ("a18", "p")])
    second = batch(spark, [EVENT["a18"]], [("a19", "q")])
    directory = ledger_of(spark, folder, [first])
    kind, calls = type(first.competitions), []
    plain = kind.subtract
    monkeypatch.setattr(kind, "subtract", lambda self, other: calls.append(1) or plain(self, other))
    ledger.update_ledger(spark, directory, second)
    assert not calls
    ledger.update_ledger(spark, directory, first)
    assert calls
    monkeypatch.undo()
    assert_same(spark, directory, joined(spark, [first, second]))


def test_tables_that_are_written_together_share_their_pairs(spark, workspace):
    kept = []
    plain = workspace.full_model
    shared = build_attendance(workspace.sources, "AMERICA", keep=lambda df: kept.append(df.persist()) or df)
    for name in ("attendance", "first_dates"):
        got, want = getattr(shared, name), getattr(plain, name)
        assert got.columns == want.columns
        assert "InMemoryTableScan" in plan_of(got)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()
    assert len(kept) == 2
    for df in kept:
        df.unpersist()
