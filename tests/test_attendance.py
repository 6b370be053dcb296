"""Attendance, debuts, periods, trends and activity on hand-made tables."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tests.tiny import HOME, competition, rows, sources
from turnout import build_attendance, last_years, period_suffix
from turnout.operators.cohorts import debuts
from turnout.plans import activity, summary, trends


def model(spark, competitions, results, persons=None):
    return build_attendance(sources(spark, competitions, results, persons), HOME)


def newcomers(m):
    return rows(m.attendance.where("is_newcomer"), "competition_id", "person_id")


def test_debut_abroad_is_not_a_debut_at_home(spark):
    m = model(
        spark,
        [competition("a", "2020-01-01", country="Away"), competition("h", "2020-02-01")],
        [("a", "p"), ("h", "p")],
    )
    assert newcomers(m) == []


def test_same_day_debut_at_home_and_abroad_counts_at_home(spark):
    m = model(
        spark,
        [competition("a", "2020-01-01", country="Away"), competition("h", "2020-01-01")],
        [("a", "p"), ("h", "p")],
    )
    assert newcomers(m) == [("h", "p")]


def test_two_home_events_on_the_debut_day(spark):
    m = model(
        spark,
        [competition("h1", "2020-01-01"), competition("h2", "2020-01-01")],
        [("h1", "p"), ("h2", "p")],
    )
    assert newcomers(m) == [("h1", "p"), ("h2", "p")]
    assert debuts(m.attendance).count() == 1


def test_cancelled_first_event_sets_the_first_date(spark):
    m = model(
        spark,
        [competition("x", "2020-01-01", cancelled=1), competition("h", "2020-02-01")],
        [("x", "p"), ("h", "p")],
    )
    assert newcomers(m) == []
    assert rows(m.attendance, "competition_id") == [("h",)]
    assert rows(m.first_dates) == [("p", datetime.date(2020, 1, 1))]


def test_unknown_cancelled_counts_as_cancelled(spark):
    m = model(spark, [competition("h", "2020-01-01", cancelled=None)], [("h", "p")])
    assert m.competitions.count() == 0


def test_several_results_are_one_attendance(spark):
    m = model(spark, [competition("h", "2020-01-01")], [("h", "p"), ("h", "p"), ("h", "q")])
    assert rows(m.attendance, "person_id") == [("p",), ("q",)]


def test_impossible_date_raises_or_is_dropped(spark):
    bad = list(competition("b", "2021-02-28"))
    bad[7] = 30
    raw = sources(spark, [tuple(bad), competition("h", "2020-01-01")], [("h", "p"), ("b", "p")])
    with pytest.raises(Exception, match="(?i)date|day"):
        build_attendance(raw, HOME).attendance.collect()
    lenient = build_attendance(raw, HOME, lenient_dates=True)
    assert rows(lenient.attendance, "competition_id") == [("h",)]
    assert rows(lenient.competitions, "competition_id") == [("h",)]


def years_model(spark):
    return model(
        spark,
        [competition(f"c{y}", f"{y}-05-05") for y in (2018, 2019, 2020, 2021)],
        [("c2018", "old"), ("c2021", "old"), ("c2020", "new"), ("c2021", "new")],
    )


def test_last_years_cut_after_debut_marking(spark):
    cut = last_years(years_model(spark), 2)
    assert rows(cut.competitions, "competition_id") == [("c2020",), ("c2021",)]
    assert newcomers(cut) == [("c2020", "new")]
    assert ("c2021", "old") in rows(cut.attendance, "competition_id", "person_id")


def test_more_years_than_there_are(spark):
    m = years_model(spark)
    assert rows(last_years(m, 99).attendance) == rows(m.attendance)
    assert last_years(m, None) is m


@pytest.mark.parametrize("years", [0, -1, 1.5, True])
def test_number_of_years_is_checked(spark, years):
    with pytest.raises(ValueError):
        last_years(years_model(spark), years)


def test_period_suffix():
    assert period_suffix(None) == "_all"
    assert period_suffix(5) == "_last5y"


def test_period_summary(spark):
    assert rows(summary.period_summary(years_model(spark), (None, 2))) == [
        ("all", 2018, 2021, 4, 4, 2),
        ("last2y", 2020, 2021, 2, 3, 2),
    ]


def test_month_gaps_and_running_total(spark):
    m = model(spark, [competition("a", "2020-01-10"), competition("b", "2020-12-10")], [])
    months = rows(trends.competitions_per_month(m))
    assert len(months) == 12 and sum(n for *_, n in months) == 2
    ytd = {month: n for _, month, n in rows(trends.competitions_year_to_date(m))}
    assert [ytd[i] for i in range(1, 13)] == [1] * 11 + [2]


def test_event_without_results_is_counted_but_has_no_field_size(spark):
    m = model(spark, [competition("a", "2020-01-10"), competition("b", "2020-01-11")], [("a", "p")])
    assert rows(trends.competitions_per_quarter(m)) == [(2020, 1, "2020 Q1", 2)]
    assert rows(trends.attendance_per_quarter(m)) == [(2020, 1, "2020 Q1", 1.0, 1.0)]


def test_median_is_exact_and_interpolated(spark):
    sizes = {"a": 1, "b": 2, "c": 3, "d": 10}
    m = model(
        spark,
        [competition(c, "2020-01-10") for c in sizes],
        [(c, f"p{i}") for c, n in sizes.items() for i in range(n)],
    )
    assert rows(trends.attendance_per_quarter(m), "mean_n", "median_n") == [(4.0, 2.5)]


def test_debut_and_second_event_in_one_quarter_are_both_counted(spark):
    m = model(
        spark,
        [competition("a", "2020-01-10"), competition("b", "2020-02-10")],
        [("a", "p"), ("b", "p")],
    )
    assert rows(activity.new_vs_returning(m)) == [(2020, 1, "2020 Q1", 1, 1)]
    assert rows(activity.newcomer_share(m), "pct_new", "avg_pct_new") == [(50.0, 50.0)]
    assert rows(activity.unique_competitors(m), "n") == [(1,)]


def test_quarter_with_returning_persons_only(spark):
    m = model(
        spark,
        [competition("a", "2020-01-10"), competition("b", "2020-05-10")],
        [("a", "p"), ("b", "p")],
    )
    assert rows(activity.new_vs_returning(m), "quarter", "newcomers", "returning") == [
        (1, 1, 0), (2, 0, 1),
    ]
    assert rows(activity.newcomer_share(m), "pct_new", "avg_pct_new") == [(0.0, 50.0), (100.0, 50.0)]


def starts_model(spark, numbers):
    most = max(numbers)
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(days=i) for i in range(most)]
    return model(
        spark,
        [competition(f"c{i}", str(day)) for i, day in enumerate(days)],
        [(f"c{i}", f"p{n}") for n in numbers for i in range(n)],
    )


def test_starts_beyond_the_cap(spark):
    m = starts_model(spark, [19, 20, 21])
    full = {b: n for _, b, n, _ in rows(activity.starts_histogram(m))}
    assert len(full) == 21 and full[19] == full[20] == full[21] == 1 and sum(full.values()) == 3
    capped = {b: n for _, b, n, _ in rows(activity.starts_histogram(m, cap=20))}
    assert len(capped) == 20 and capped[19] == 1 and capped[20] == 2
    assert rows(activity.starts_histogram(m).select("median_n").distinct()) == [(20.0,)]


def test_histogram_bins_end_at_the_largest_value(spark):
    assert rows(activity.starts_histogram(starts_model(spark, [1, 3])), "n_comps", "n_persons") == [
        (1, 1), (2, 0), (3, 1),
    ]


def test_activity_trend_percentiles(spark):
    m = starts_model(spark, [1, 2, 3, 10])
    assert rows(activity.activity_trend(m)) == [(2020, 4.0, 2.5, 4.75)]


def test_consistently_active_needs_three_quarters(spark):
    days = ["2020-01-10", "2020-04-10", "2020-07-10", "2020-07-11"]
    m = model(
        spark,
        [competition(f"c{i}", day) for i, day in enumerate(days)],
        [("c0", "three"), ("c1", "three"), ("c2", "three"), ("c0", "two"), ("c2", "two"), ("c3", "two")],
    )
    assert rows(activity.consistently_active(m)) == [(2020, 1)]


def test_a_person_without_a_current_record_still_attends(spark):
    m = model(spark, [competition("h", "2020-01-01")], [("h", "p")], [("p", 2, "old", HOME)])
    assert m.attendance.count() == 1 and m.persons.count() == 0
    assert m.attendance.where(F.col("is_newcomer")).count() == 1
