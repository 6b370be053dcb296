"""Regions and travel spread against brute force."""

from __future__ import annotations

import math
import random

import pytest

from tests.tiny import HOME, competition, rows, sources
from turnout.functions.geodesy import haversine_km
from turnout.operators.components import connected_components
from turnout.operators.regions import geo_regions
from turnout.operators import spread
from turnout.operators.spread import person_spread
from turnout.plans import travel


def km(p, q):
    (a, b), (c, d) = p, q
    h = math.sin(math.radians(c - a) / 2) ** 2
    h += math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def brute_regions(places, radius):
    """Smallest id of the component of each id, by flood fill."""
    label = {}
    for start in sorted(places):
        if start in label:
            continue
        label[start], stack = start, [start]
        while stack:
            here = stack.pop()
            for other in places:
                if other not in label and km(places[here], places[other]) <= radius:
                    label[other] = start
                    stack.append(other)
    return label


def region_map(spark, places, radius=50.0, **options):
    events = spark.createDataFrame(
        [(id, float(lat), float(lon)) for id, (lat, lon) in places.items()],
        "competition_id string, lat double, lon double",
    )
    return dict(rows(geo_regions(events, radius, **options)))


def test_haversine(spark):
    df = spark.createDataFrame([(50.0, 20.0, 51.0, 21.0)], "a double, b double, c double, d double")
    value = df.select(haversine_km(df.a, df.b, df.c, df.d).alias("v")).first().v
    assert value == pytest.approx(km((50.0, 20.0), (51.0, 21.0)), rel=1e-12)


def test_chain_is_one_region(spark):
    step = 40 / 111.19
    places = {"a": (50.0, 20.0), "b": (50.0 + step, 20.0), "c": (50.0 + 2 * step, 20.0), "far": (52.0, 20.0)}
    assert region_map(spark, places) == {"a": "a", "b": "a", "c": "a", "far": "far"}


def test_poles_and_date_line(spark):
    places = {
        "e": (0.0, 179.9), "w": (0.0, -179.9),
        "n1": (89.9, 0.0), "n2": (89.9, 180.0), "n3": (89.9, -90.0),
        "s": (-90.0, 17.0), "lone": (10.0, 10.0),
    }
    assert region_map(spark, places) == brute_regions(places, 50.0)


def test_equal_places_share_a_region(spark):
    assert region_map(spark, {"x": (1.0, 1.0), "a": (1.0, 1.0)}) == {"x": "a", "a": "a"}


def test_radius_is_checked(spark):
    with pytest.raises(ValueError):
        region_map(spark, {"a": (0.0, 0.0)}, radius=0.001)


@pytest.mark.parametrize("seed, radius, budget", [(1, 50.0, 4096), (2, 30.0, 1), (3, 12.0, 4), (4, 500.0, 16)])
def test_regions_match_brute_force(spark, seed, radius, budget):
    """A budget of a few pairs forces the refinement that crowded places take."""
    rng = random.Random(seed)
    centres = [(rng.uniform(49, 54), rng.uniform(14, 24)) for _ in range(12)]
    places = {}
    for i in range(160):
        lat, lon = rng.choice(centres)
        places[f"c{i:03}"] = (round(lat + rng.gauss(0, 0.15), 6), round(lon + rng.gauss(0, 0.2), 6))
    assert region_map(spark, places, radius, pair_budget=budget) == brute_regions(places, radius)


def test_two_crowds_just_apart(spark):
    """Facing edges a little over and a little under the radius, with no other link."""
    rng = random.Random(9)
    left = {f"l{i:02}": (50.0 + rng.uniform(-0.05, 0.05), 20.0 - rng.uniform(0, 0.1)) for i in range(30)}
    for gap, joined in ((50.1, False), (49.9, True)):
        offset = gap / (111.19492664455873 * math.cos(math.radians(50.0)))
        right = {"r0": (50.0, 20.0 + offset), **{f"r{i}": (50.0, 20.0 + offset + i * 0.01) for i in range(1, 10)}}
        places = {**left, "edge": (50.0, 20.0), **right}
        labels = region_map(spark, places, 50.0, pair_budget=2)
        assert labels == brute_regions(places, 50.0)
        assert (labels["r0"] == labels["edge"]) is joined


def test_components_of_a_long_chain(spark):
    names = list(range(60))
    random.Random(5).shuffle(names)
    edges = [(a, b) for a, b in zip(names, names[1:])] + [(100, 101), (7, 7)]
    found = dict(rows(connected_components(spark.createDataFrame(edges, "u bigint, v bigint"))))
    assert found == {**{n: 0 for n in names}, 100: 100, 101: 100}


def test_components_without_edges(spark):
    assert rows(connected_components(spark.createDataFrame([], "u bigint, v bigint"))) == []


def spread_map(spark, starts, **options):
    df = spark.createDataFrame(starts, "person_id string, region string, lat double, lon double")
    return {
        r.person_id: (r.n_starts, r.n_regions, r.spread_km) for r in person_spread(df, **options).collect()
    }


def test_one_place_has_no_spread(spark):
    starts = [("p", "r", 50.0, 20.0), ("p", "r", 50.0, 20.0), ("q", "r", 1.0, 1.0)]
    assert spread_map(spark, starts) == {"p": (2, 1, 0.0), "q": (1, 1, 0.0)}


@pytest.mark.parametrize(
    "seed, box, in_row, budget",
    [
        (1, (49, 54, 14, 24), 64, 4096),  # short rows only
        (2, (49, 54, 14, 24), 3, 4096),  # box search, one level
        (3, (49, 54, 14, 24), 3, 4),  # box search, many levels
        (4, (-90, 90, -180, 180), 3, 4),  # whole globe, near-antipodes
        (5, (50, 50.0001, 20, 20.0001), 3, 1),  # places a few metres apart
    ],
)
def test_spread_matches_brute_force(spark, seed, box, in_row, budget):
    rng = random.Random(seed)
    south, north, west, east = box
    starts, places = [], {}
    for person, n in (("one", 1), ("two", 2), ("few", 5), ("many", 70)):
        for i in range(n):
            spot = (round(rng.uniform(south, north), 6), round(rng.uniform(west, east), 6))
            places.setdefault(person, []).append(spot)
            starts += [(person, f"r{i % 3}", *spot)] * rng.choice([1, 1, 2])
    found = spread_map(spark, starts, points_in_row=in_row, pair_budget=budget)
    for person, spots in places.items():
        expected = max(km(p, q) for p in spots for q in spots)
        assert found[person][2] == pytest.approx(expected, rel=1e-9, abs=1e-9)
        assert found[person][0] == sum(1 for s in starts if s[0] == person)
        assert found[person][1] == min(3, len(spots))


@pytest.mark.parametrize("shape", ["disk", "circle", "line", "globe", "clusters"])
def test_few_places_stay_and_the_farthest_two_do(spark, monkeypatch, shape):
    rng = random.Random(7)
    spots = []
    for k in range(400):
        angle, r = rng.uniform(0, 2 * math.pi), rng.random() ** 0.5
        spots.append({
            "disk": (50 + 3 * r * math.sin(angle), 20 + 4 * r * math.cos(angle)),
            "circle": (50 + 0.01 * math.sin(angle), 20 + 0.015 * math.cos(angle)),
            "line": (10 + k / 100, 170 + k / 50 if k < 200 else k / 50 - 190),
            "globe": (math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)),
            "clusters": (rng.choice([48, 52, 55]) + rng.gauss(0, 0.01), rng.choice([10, 20]) + rng.gauss(0, 0.01)),
        }[shape])
    ends = []
    plain = spread.cut
    monkeypatch.setattr(spread, "cut", lambda df: ends.append(plain(df)) or ends[-1])
    starts = [("p", "r", lat, lon) for lat, lon in spots] + [("q", "r", 1.0, 1.0)]
    found = spread_map(spark, starts)
    assert found["p"][2] == pytest.approx(max(km(p, q) for p in spots for q in spots), rel=1e-9)
    assert found["p"][:2] == (400, 1) and found["q"] == (1, 1, 0.0)
    if shape in ("disk", "line"):
        # Two tables are stored and no search begins: all places, and those that may be ends.
        assert len(ends) == 2 and ends[1].count() < 160 and ends[1].where("person_id = 'q'").isEmpty()


def test_directions_leave_no_gap():
    assert len(spread.DIRECTIONS) == 13
    rng = random.Random(3)
    worst = 1.0
    for _ in range(20_000):
        v = [rng.gauss(0, 1) for _ in range(3)]
        n = math.sqrt(sum(c * c for c in v))
        worst = min(worst, max(abs(sum(a * b for a, b in zip(v, d))) / n for d in spread.DIRECTIONS))
    assert spread.NARROWEST <= worst < spread.NARROWEST + 0.01


def year_map(spark):
    comps = [
        competition("a", "2020-01-01", cell="North", lat=54.0, lon=20.0),
        competition("b", "2020-02-01", cell="North", lat=54.1, lon=20.0),
        competition("c", "2020-03-01", cell=None, lat=50.0, lon=20.0),
        competition("gone", "2020-03-02", cancelled=1, lat=50.0, lon=20.0),
        competition("nowhere", "2020-03-03", lat=None, lon=20.0),
        competition("early", "2019-03-03", lat=50.0, lon=20.0),
    ]
    results = [("a", "loc"), ("a", "loc"), ("b", "loc"), ("a", "far"), ("c", "far"), ("a", "guest"), ("b", "stale")]
    results += [("c", "loc2"), ("early", "loc"), ("gone", "loc"), ("nowhere", "loc")]
    persons = [
        ("loc", 1, "Local", HOME), ("loc", 2, "Old name", "Away"), ("far", 1, "Far", HOME),
        ("guest", 1, "Guest", "Away"), ("stale", 2, "Stale", HOME), ("loc2", 1, "Second", HOME),
    ]
    return travel.year_map(sources(spark, comps, results, persons), 2020, HOME)


def test_densities_and_locals(spark):
    map_ = year_map(spark)
    assert rows(travel.density_all(map_), "competition_id", "cell_name", "n", "popup") == [
        ("a", "North", 3, "North: 3"), ("b", "North", 1, "North: 1"),
    ]
    region_of = travel.regions(map_)
    assert rows(region_of) == [("a", "a"), ("b", "a"), ("c", "c")]
    spread = travel.spread(map_, region_of)
    assert rows(spread, "person_id", "n_starts", "n_regions", "is_local") == [
        ("far", 2, 2, False), ("loc", 2, 1, True), ("loc2", 1, 1, True),
    ]
    assert rows(travel.globetrotters(map_, spread, 2), "rank", "name") == [(1, "Far"), (2, "Local")]
    assert rows(travel.density_locals(map_, spread), "competition_id", "n") == [("a", 1), ("b", 1)]
    assert rows(travel.locals_by_region(map_, region_of, spread), "region", "n", "lon") == [
        ("a", 1, 20.0), ("c", 1, 20.0),
    ]


def test_locals_thresholds(spark):
    map_ = year_map(spark)
    region_of = travel.regions(map_)
    assert rows(travel.spread(map_, region_of, max_regions=0), "is_local") == [(False,)] * 3
    assert rows(travel.spread(map_, region_of, max_spread_km=1000.0), "is_local") == [(True,)] * 3
