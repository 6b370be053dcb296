"""Reading delimited text, parquet and arbitrary DataFrames; writing tables."""

from __future__ import annotations

import datetime
import glob
import os

import pytest

from tests.tiny import HOME, competition, rows, sources
from turnout import build_attendance, last_years, read_delimited, read_tables
from turnout.operators.returning import returning_newcomers
from turnout.plans import bundle, newcomers
from turnout.plans.catalogue import rounded
from turnout.sources.sinks import read_table
from turnout.sources.store import read_model, write_model
from turnout.sources.tables import COMPETITIONS, RESULTS, conform, sources_from

COMPETITION_LINES = [
    # Columns out of order, one unknown to the library.
    "cancelled\tid\tname\tcity_name\tcountry_id\tyear\tmonth\tday\tevent_specs\tlatitude_microdegrees"
    "\tlongitude_microdegrees\tinformation\tcell_name\tend_date",
    '0\tA1\t"Open ""Big"" 2020"\tNA\tHome\t2020\t1\t5\t333 222\t50000000\t20000000\tx\t"Big, Cell"\t2020-01-06',
    '0\tA2\tOpen 2021\tŁódź\tHome\t2021\t3\t6\t""\tNULL\tNULL\ty\tNULL\tNULL',
    "1\tA3\tGone\tTown\tHome\t2021\t4\t6\t333\t50000000\t20000000\t\tCell\t2021-04-06",
    "0\t\tNo key\tTown\tHome\t2021\t4\t6\t333\t50000000\t20000000\t\tCell\t2021-04-06",
]
RESULT_LINES = [
    "person_id\tcompetition_id\tvalue1\tperson_country_id",
    "P1\tA1\t1000\tHome",
    "P1\tA1\t1100\tHome",
    "P1\tA2\t1200\tHome",
    "P2\tA2\t-1\tAway",
    "P3\tNULL\t1\tAway",
]
PERSON_LINES = ["name\tcountry_id\tkey\tsub_id", "Jan Kowalski\tHome\tP1\t1", "Jan\tAway\tP1\t2", "Ann\tAway\tP2\t1"]


def write_lines(folder, name, lines):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as file:
        file.write("\n".join(lines) + "\n")
    return path


@pytest.fixture
def paths(folder):
    return [
        write_lines(folder, "competitions.tsv", COMPETITION_LINES),
        write_lines(folder, "results.tsv", RESULT_LINES),
        write_lines(folder, "persons.tsv", PERSON_LINES),
    ]


def test_tab_separated_export(spark, paths):
    raw = read_tables(spark, *paths, person_key="key")
    assert raw.competitions.schema.simpleString() == COMPETITIONS.simpleString()
    assert raw.results.schema.simpleString() == RESULTS.simpleString()
    assert rows(raw.competitions, "id", "name", "city_name", "cell_name", "event_specs", "latitude_microdegrees") == [
        ("A1", 'Open "Big" 2020', "NA", "Big, Cell", "333 222", 50000000),
        ("A2", "Open 2021", "Łódź", None, None, None),
        ("A3", "Gone", "Town", "Cell", "333", 50000000),
    ]
    assert raw.results.count() == 4
    m = build_attendance(raw, HOME)
    assert rows(m.persons) == [("P1", "Jan Kowalski", "Home"), ("P2", "Ann", "Away")]
    assert rows(m.attendance, "competition_id", "person_id", "date", "is_newcomer") == [
        ("A1", "P1", datetime.date(2020, 1, 5), True),
        ("A2", "P1", datetime.date(2021, 3, 6), False),
        ("A2", "P2", datetime.date(2021, 3, 6), True),
    ]


def test_parquet_and_frames_give_the_same(spark, folder, paths):
    raw = read_tables(spark, *paths, person_key="key")
    for name in ("competitions", "results", "persons"):
        getattr(raw, name).write.parquet(f"{folder}/{name}.parquet")
    stored = read_tables(
        spark, *[f"{folder}/{n}.parquet" for n in ("competitions", "results", "persons")], format="parquet"
    )
    assert rows(build_attendance(stored, HOME).attendance) == rows(build_attendance(raw, HOME).attendance)
    frames = sources_from(stored.competitions, stored.results, stored.persons.withColumnRenamed("person_id", "k"), "k")
    assert rows(frames.persons) == rows(raw.persons)


def test_comma_separated(spark, folder):
    path = write_lines(folder, "r.csv", ["competition_id,person_id", '"a,1",p'])
    assert rows(conform(read_delimited(spark, path, ","), RESULTS)) == [("a,1", "p", None)]


def test_missing_key_column(spark):
    with pytest.raises(ValueError, match="competition_id"):
        conform(spark.createDataFrame([("p",)], "person_id string"), RESULTS)


def small_model(spark):
    comps = [competition(f"c{y}", f"{y}-01-0{i}", name=f"Cup {y}", lat=50, lon=20, specs="333") for i, y in enumerate((2019, 2020, 2021), 1)]
    raw = sources(spark, comps, [("c2019", "p"), ("c2020", "p"), ("c2021", "q"), ("c2021", "p")])
    return raw, build_attendance(raw, HOME)


def test_bundle_writes_every_chart_for_both_periods(spark, folder):
    _, m = small_model(spark)
    written = bundle.write_bundle(m, folder)
    names = [os.path.basename(path) for path, _ in written]
    assert len(names) == len(set(names)) == 2 * (len(bundle.CHARTS) + 1) + 1
    assert {n for n in names if n.startswith("06_")} == {"06_new_vs_returning_all", "06_new_vs_returning_last5y"}
    assert rows(spark.read.parquet(f"{folder}/00_period_all")) == [(2019, 2021, "2019–2021")]
    assert rows(spark.read.parquet(f"{folder}/13_cohort_retention_all")) == rows(newcomers.retention(m))
    assert all(title for _, title in written)


def test_charts_of_all_periods_are_computed_once_where_years_stand_alone(spark, folder):
    comps = [competition(f"c{y}{m}", f"{y}-{m:02}-10", name=f"Cup {y}", city=f"T{m}") for y in range(2015, 2022) for m in (1, 4, 5, 11)]
    results = [(c[0], f"p{k}") for n, c in enumerate(comps) for k in range(n % 5, n + 3, 2)]
    m = build_attendance(sources(spark, comps, results), HOME)
    runs = {}

    def counted(name, plan):
        def run(model):
            runs[name] = runs.get(name, 0) + 1
            return plan(model)

        return run

    charts = [(name, title, counted(name, plan)) for name, title, plan in bundle.CHARTS]
    periods = (3, None, 1)  # in any order
    written = bundle.write_bundle(m, folder, periods, charts)
    assert [p.rsplit("/", 1)[1] for p, _ in written if "/00_" in p] == ["00_period_last3y", "00_period_all", "00_period_last1y"]
    assert {name: n for name, n in runs.items()} == {name: 1 if name in bundle.YEAR_BY_YEAR else 3 for name, _, _ in bundle.CHARTS}
    for name, _, plan in bundle.CHARTS:
        for years, suffix in ((None, "_all"), (3, "_last3y"), (1, "_last1y")):
            want = plan(last_years(m, years))
            # Means are rounded, as the order of their sums is not fixed.
            got = read_table(spark, f"{folder}/{name}{suffix}", want.schema)
            assert rows(rounded(got, 9)) == rows(rounded(want, 9)), (name, years)
    csv = bundle.write_bundle(m, f"{folder}/csv", (None, 2), bundle.CHARTS[7:8], "csv")
    got = read_table(spark, csv[3][0], bundle.CHARTS[7][2](m).schema, "csv")
    assert rows(got) == rows(bundle.CHARTS[7][2](last_years(m, 2)))


def test_bundle_can_be_written_again(spark, folder):
    _, m = small_model(spark)
    for _ in range(2):
        bundle.write_bundle(m, folder, periods=(None,), charts=bundle.CHARTS[:1])
    assert spark.read.parquet(f"{folder}/01_comps_per_quarter_all").count() == 3


def test_csv_reports(spark, folder):
    raw, m = small_model(spark)
    cohorts = spark.read.option("header", True).csv(bundle.write_cohort_summary(m, folder, 2))
    assert cohorts.columns[:4] == ["year", "quarter", "label", "newcomers"]
    assert rows(cohorts, "year", "newcomers") == [("2021", "1")]
    matrix = spark.read.option("header", True).csv(bundle.write_series_matrix(m, folder))
    assert [tuple(r) for r in matrix.collect()] == [("Cup (Sty)", "1", "1", "2")]
    path = bundle.write_returning_newcomers(raw, folder, 2021, HOME)
    report = spark.read.option("header", True).csv(path)
    assert rows(report) == [("c2021", "Cup 2021", "1", "0")]


def test_stored_model_is_pruned_by_year(spark, folder):
    _, m = small_model(spark)
    write_model(m, folder)
    stored = read_model(spark, folder)
    columns = m.attendance.columns
    assert rows(stored.attendance, *columns) == rows(m.attendance)
    assert rows(newcomers.retention(stored)) == rows(newcomers.retention(m))
    recent = last_years(stored, 1).attendance
    assert rows(recent, *columns) == rows(last_years(m, 1).attendance)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "Subquery" in plan


@pytest.mark.parametrize("column", ["country_id", "year", "month", "day", "cancelled"])
def test_required_columns_of_competitions(spark, column):
    raw = sources(spark, [competition("a", "2020-01-01")], [])
    with pytest.raises(ValueError, match=column):
        sources_from(raw.competitions.drop(column), raw.results, raw.persons)


@pytest.mark.parametrize("column", ["sub_id", "country_id"])
def test_required_columns_of_persons(spark, column):
    raw = sources(spark, [competition("a", "2020-01-01")], [])
    with pytest.raises(ValueError, match=column):
        sources_from(raw.competitions, raw.results, raw.persons.drop(column))


def test_start_date_follows_from_its_parts_and_end_date_is_asked_for(spark):
    raw = sources(spark, [competition("a", "2020-02-03")], [("a", "p")])
    derived = sources_from(raw.competitions.drop("start_date", "end_date"), raw.results, raw.persons)
    assert str(derived.competitions.first().start_date) == "2020-02-03"
    with pytest.raises(ValueError, match="end_date"):
        returning_newcomers(derived.competitions, derived.results, 2020, HOME)


def test_files_with_another_order_of_columns_are_refused(spark, folder):
    for name, text in (("1.tsv", "id\tyear\n" + "a\t2020\n" * 3), ("2.tsv", "year\tid\n2021\tb\n")):
        with open(f"{folder}/{name}", "w") as file:
            file.write(text)
    with pytest.raises(Exception, match="(?i)header"):
        read_delimited(spark, folder).collect()


def test_stored_years_are_few_files_each_and_crowded_ones_are_split(spark, folder):
    comps = [competition(f"c{y}", f"{y}-01-01") for y in range(2010, 2016)]
    m = build_attendance(sources(spark, comps, [(c[0], f"p{i}") for c in comps for i in range(20)]), HOME)
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        write_model(m, folder)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(glob.glob(f"{folder}/attendance/year=*/*.parquet")) == 6
