"""Retention, return counts and the returning-newcomers report on hand-made tables."""

from __future__ import annotations

import datetime

import pytest

from tests.tiny import HOME, competition, rows, sources
from turnout import build_attendance, last_years
from turnout.functions.numbers import percentage_one_decimal
from turnout.operators.cohorts import followups, return_counts
from turnout.operators.returning import returning_newcomers
from turnout.plans import newcomers
from pyspark.sql import functions as F

START = datetime.date(2021, 1, 1)


def after(days):
    return str(START + datetime.timedelta(days=days))


def retention_of(spark, days):
    comps = [competition("debut", str(START))] + [competition(f"d{d}", after(d)) for d in days]
    results = [("debut", "p")] + [(f"d{d}", "p") for d in days]
    return build_attendance(sources(spark, comps, results), HOME)


@pytest.mark.parametrize(
    "day, expected",
    [(90, (1, 1, 1)), (91, (0, 1, 1)), (180, (0, 1, 1)), (181, (0, 0, 1)), (365, (0, 0, 1)), (366, (0, 0, 0))],
)
def test_window_edges(spark, day, expected):
    m = retention_of(spark, [day])
    assert rows(newcomers.retention(m), "ret_3m", "ret_6m", "ret_12m") == [expected]


def test_cohort_without_returns_is_kept(spark):
    row = newcomers.retention(retention_of(spark, [])).first()
    assert (row.newcomers, row.ret_12m, row.pct_12m, row.label) == (1, 0, 0.0, "2021 Q1")


def test_second_event_on_the_debut_day_is_no_return(spark):
    comps = [competition("a", str(START)), competition("b", str(START))]
    raw = sources(spark, comps, [("a", "p"), ("b", "p")])
    m = build_attendance(raw, HOME)
    assert rows(return_counts(m.attendance)) == [("p", 0)]
    assert rows(newcomers.retention(m), "ret_12m") == [(0,)]
    assert rows(followups(m.attendance), "competition_id", "days_after") == [("a", 0), ("b", 0)]
    # The yearly report counts any second event.
    assert rows(returning_newcomers(raw.competitions, raw.results, 2021, HOME)) == [
        ("a", "Open a", 1, 1), ("b", "Open b", 1, 1),
    ]


def test_returns_abroad_do_not_count_for_retention(spark):
    comps = [competition("h", str(START)), competition("a", after(10), country="Away")]
    raw = sources(spark, comps, [("h", "p"), ("a", "p")])
    assert rows(newcomers.retention(build_attendance(raw, HOME)), "ret_3m") == [(0,)]
    assert rows(returning_newcomers(raw.competitions, raw.results, 2021, HOME), "returned_newcomers") == [(1,)]


def test_people_who_debuted_before_the_period_are_no_cohort(spark):
    comps = [competition("a", "2019-05-05"), competition("b", "2021-05-05")]
    m = build_attendance(sources(spark, comps, [("a", "p"), ("b", "p"), ("b", "q")]), HOME)
    assert rows(newcomers.retention(last_years(m, 1)), "year", "newcomers") == [(2021, 1)]
    assert rows(return_counts(last_years(m, 1).attendance)) == [("q", 0)]


def returns_model(spark, numbers):
    most = max(numbers)
    comps = [competition(f"c{i}", after(i)) for i in range(most + 1)]
    results = [(f"c{i}", f"p{n}") for n in numbers for i in range(n + 1)]
    return build_attendance(sources(spark, comps, results), HOME)


def test_returns_beyond_the_cap(spark):
    m = returns_model(spark, [0, 24, 25, 26])
    full = {b: n for b, n, *_ in rows(newcomers.return_distribution(m))}
    assert len(full) == 27 and (full[0], full[24], full[25], full[26]) == (1, 1, 1, 1)
    capped = {b: n for b, n, *_ in rows(newcomers.return_distribution(m, cap=25))}
    assert len(capped) == 26 and capped[25] == 2 and sum(capped.values()) == 4
    head = newcomers.return_distribution(m).first()
    assert (head.n_never, head.n_total, head.pct_never) == (1, 4, 25.0)


def test_nobody_new(spark):
    comps = [competition("a", "2020-01-01", country="Away"), competition("h", "2020-02-01")]
    m = build_attendance(sources(spark, comps, [("a", "p"), ("h", "p")]), HOME)
    assert newcomers.retention(m).count() == 0
    assert newcomers.debuts_per_quarter(m).count() == 0
    assert newcomers.return_distribution(m).count() == 0


@pytest.mark.parametrize("part, whole, expected", [(1, 8, 12.5), (1, 3, 33.3), (2, 3, 66.7), (1, 16, 6.3), (0, 0, 0.0)])
def test_one_decimal(spark, part, whole, expected):
    value = percentage_one_decimal(F.lit(part), F.lit(whole))
    assert spark.range(1).select(value.alias("v")).first().v == expected


def test_returning_newcomers_candidates(spark):
    comps = [
        competition("old", "2020-12-31", end="2021-01-01"),
        competition("cancelled", "2021-02-01", cancelled=1),
        competition("empty", "2021-03-01"),
        competition("next", "2021-12-31", end="2022-01-01"),
        competition("away", "2021-01-05", country="Away"),
    ]
    raw = sources(spark, comps, [("old", "p"), ("old", "p"), ("cancelled", "q"), ("next", "q"), ("away", "r")])
    assert rows(returning_newcomers(raw.competitions, raw.results, 2021, HOME)) == [
        ("cancelled", "Open cancelled", 1, 1),
        ("empty", "Open empty", 0, 0),
        ("old", "Open old", 1, 0),
    ]


def test_results_of_an_unknown_event_count_as_an_event_there(spark):
    raw = sources(spark, [competition("h", "2021-01-01")], [("h", "p"), ("unknown", "p")])
    assert rows(returning_newcomers(raw.competitions, raw.results, 2021, HOME)) == [("h", "Open h", 1, 1)]
