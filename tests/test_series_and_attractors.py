"""Recurring series and newcomer attraction on hand-made tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.tiny import HOME, competition, rows, sources
from turnout import build_attendance, last_years
from turnout.functions.text import display_name, series_name, shorten, tokens, with_month
from turnout.operators.series import recurring_series
from turnout.plans import attraction, recurring


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "name, expected",
    [
        ("Open 2021 Łódź", "Open Łódź"),
        ("Open 2022 Łódź", "Open Łódź"),
        ("Open2023", "Open2023"),
        ("Łódź2023 A 2023 2024B", "Łódź2023 A 2024B"),
        ("  A  2024  B ", "A B"),
        ("\tA 2024", "A"),
        ("2024", ""),
    ],
)
def test_series_name(spark, name, expected):
    assert one(spark, series_name(F.lit(name))) == expected


def test_labels(spark):
    assert one(spark, with_month(F.lit("Open"), F.lit(5))) == "Open (Maj)"
    assert one(spark, with_month(F.lit("Open"), F.lit(None).cast("int"))) == "Open"
    assert one(spark, shorten(F.lit("x" * 38))) == "x" * 38
    assert one(spark, shorten(F.lit("x" * 39))) == "x" * 35 + "..."


@pytest.mark.parametrize("text, expected", [("333  222 333", ["333", "222", "333"]), ("", []), (" a ", ["a"]), (None, None)])
def test_tokens(spark, text, expected):
    assert one(spark, tokens(F.lit(text).cast("string"))) == expected


def test_display_name_falls_back_to_the_code(spark):
    assert one(spark, display_name(F.lit("a"), {"a": "Alpha"})) == "Alpha"
    assert one(spark, display_name(F.lit("b"), {"a": "Alpha"})) == "b"
    assert one(spark, display_name(F.lit("b"), {})) == "b"


def series_model(spark, editions, attendance=()):
    comps = [competition(id, date, name=name) for id, date, name in editions]
    return build_attendance(sources(spark, comps, list(attendance) or [("none", "p")]), HOME)


def test_three_different_years_make_a_series(spark):
    m = series_model(
        spark,
        [("a", "2019-01-01", "Two 2019"), ("b", "2020-01-01", "Two 2020"), ("c", "2020-02-01", "Two 2020")]
        + [(f"t{y}", f"{y}-06-01", f"Three {y}") for y in (2019, 2020, 2021)],
    )
    series = recurring_series(m.competitions, m.attendance)
    assert rows(series, "series", "label", "editions", "total") == [("Three", "Three (Cze)", 0, 0)]


@pytest.mark.parametrize("months, label", [((6, 7, 6, 7), "S (Cze)"), ((7, 8, 7, 8), "S (Sie)"), ((1, 12, 12, 12), "S (Gru)")])
def test_typical_month_is_the_half_even_median(spark, months, label):
    m = series_model(
        spark, [(f"c{i}", f"{2018 + i}-{month:02}-01", f"S {2018 + i}") for i, month in enumerate(months)]
    )
    assert rows(recurring_series(m.competitions, m.attendance), "label") == [(label,)]


def heat_model(spark):
    comps = [(f"a{y}", f"{y}-01-01", f"A {y}") for y in (2019, 2020, 2021)]
    comps += [(f"b{y}", f"{y}-03-01", f"B {y}") for y in (2018, 2019, 2020, 2021)]
    comps += [("b2", "2021-04-01", "B 2021")]
    attendance = [(f"a{y}", f"p{i}") for y in (2019, 2020, 2021) for i in range(10)]
    attendance += [("b2018", "p1"), ("b2019", "p1"), ("b2020", "p1"), ("b2021", "p1"), ("b2", "p1"), ("b2", "p2")]
    attendance += [("b2021", f"p{i}") for i in range(3, 7)]
    return series_model(spark, comps, attendance)


def test_heatmap_cells(spark):
    cells = rows(recurring.series_heatmap(heat_model(spark)), "rank", "label", "year", "n_competitors", "cell_text", "shade")
    assert cells == [
        (1, "B (Mar)", 2018, 1, "1", "light"),
        (1, "B (Mar)", 2019, 1, "1", "light"),
        (1, "B (Mar)", 2020, 1, "1", "light"),
        (1, "B (Mar)", 2021, 7, "7", "dark"),
        (2, "A (Sty)", 2018, 0, "—", "empty"),
        (2, "A (Sty)", 2019, 10, "10", "dark"),
        (2, "A (Sty)", 2020, 10, "10", "dark"),
        (2, "A (Sty)", 2021, 10, "10", "dark"),
    ]


def test_trend_and_matrix(spark):
    m = heat_model(spark)
    assert rows(recurring.series_trend(m, limit=1)) == [
        (1, "B (Mar)", 2018, 1), (1, "B (Mar)", 2019, 1), (1, "B (Mar)", 2020, 1), (1, "B (Mar)", 2021, 7),
    ]
    wide = recurring.series_wide(m)
    assert wide.columns == ["series", "2018", "2019", "2020", "2021"]
    assert [tuple(r) for r in wide.collect()] == [("B (Mar)", 1, 1, 1, 7), ("A (Sty)", 0, 10, 10, 10)]


def test_two_years_hold_no_series(spark):
    m = last_years(heat_model(spark), 2)
    assert recurring.series_heatmap(m).count() == 0
    assert recurring.series_trend(m).count() == 0
    assert recurring.series_wide(m).columns == ["series"]


def attract_model(spark):
    comps = [
        competition("b", "2020-01-01", city="X", specs="333 222", lat=50, lon=20),
        competition("a", "2020-02-01", city="Y", specs="333  odd 333", lat=51, lon=21),
        competition("c", "2021-01-01", city="X", specs=None, lat=None, lon=None),
        competition("d", "2021-01-02", city=None, specs=" "),
        competition("empty", "2021-01-03", city="Z", specs="sq1"),
    ]
    results = [("b", "p1"), ("b", "p2"), ("a", "p1"), ("a", "p3"), ("a", "p4"), ("a", "p1")]
    results += [("c", "p1"), ("d", "p5"), ("d", "p1")]
    return build_attendance(sources(spark, comps, results), HOME)


def test_ties_in_the_top_list_go_to_the_smaller_id(spark):
    top = attraction.top_by_newcomers(attract_model(spark), limit=2)
    assert rows(top, "rank", "competition_id", "newcomers") == [(1, "a", 2), (2, "b", 2)]


def test_minimum_field_for_shares(spark):
    top = attraction.top_by_share(attract_model(spark), min_competitors=2)
    assert rows(top, "rank", "competition_id", "total") == [(1, "b", 2), (2, "a", 3), (3, "d", 2)]
    assert attraction.top_by_share(attract_model(spark)).count() == 0


def test_cities(spark):
    cities = attraction.city_bubbles(attract_model(spark), labelled=1)
    assert rows(cities, "city_name", "total_newcomers", "avg_newcomers", "n_comps", "lat", "lon", "bubble_size", "is_labelled") == [
        ("X", 2, 1.0, 2, 50.0, 20.0, 5.0, True),
        ("Y", 2, 2.0, 1, 51.0, 21.0, 5.0, False),
    ]


def test_calendar_months(spark):
    months = rows(attraction.by_calendar_month(attract_model(spark)))
    assert [(m, c, round(p, 6)) for m, c, p in months] == [(1, 1.0, 50.0), (2, 2.0, 66.666667)]


def test_repeated_element_weighs_twice_in_the_mean_and_once_in_the_count(spark):
    by_event = {r.event_id: r for r in attraction.by_event_offered(attract_model(spark)).collect()}
    assert set(by_event) == {"333", "222", "odd"}
    assert by_event["333"].event_name == "3x3x3" and by_event["odd"].event_name == "odd"
    assert by_event["333"].n_comps == 2
    assert round(by_event["333"].avg_pct, 6) == round((100 + 2 * 200 / 3) / 3, 6)
    assert round(by_event["odd"].overall_avg, 6) == round((100 + 200 / 3 + 0 + 50) / 4, 6)
    assert by_event["222"].band == "above"
