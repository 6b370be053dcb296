"""A growing map against regions of all events at once, and what an addition looks at."""

from __future__ import annotations

import itertools
import random

import pytest

from tests.tiny import rows
from turnout.operators import regions
from turnout.sources import region_map, versions

EVENTS = "competition_id string, lat double, lon double"


def frame(spark, places):
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in places.items()], EVENTS)


def grown(spark, directory, batches, radius=50.0, **options):
    region_map.create_map(spark, directory, radius)
    for batch in batches:
        region_map.add_events(spark, directory, frame(spark, batch), **options)
    return rows(region_map.map_regions(spark, directory), "competition_id", "region")


def test_three_batches_in_any_order(spark, folder):
    rng = random.Random(4)
    places = {f"e{k:03}": (50 + rng.uniform(-2, 2), 20 + rng.uniform(-3, 3)) for k in range(70)}
    places |= {f"f{k}": (rng.choice([-1, 1]) * (89.9 - k / 10), 60.0 * k) for k in range(6)}  # poles
    places |= {f"g{k}": (0.1 * k, 179.9 if k % 2 else -179.9) for k in range(6)}  # date line
    names = sorted(places, key=lambda _: rng.random())
    batches = [{n: places[n] for n in names[k::3]} for k in range(3)]
    want = rows(regions.geo_regions(frame(spark, places)), "competition_id", "region")
    for n, order in enumerate(list(itertools.permutations(batches))[::2]):
        assert grown(spark, f"{folder}/{n}", order) == want


def test_a_bridge_joins_regions_far_away(spark, folder):
    left = {f"l{k}": (50.0, 10 + 0.5 * k) for k in range(8)}
    right = {f"r{k}": (50.0, 14.8 + 0.5 * k) for k in range(8)}
    bridge = {"a": (50.0, 14.15)}
    directory = f"{folder}/map"
    assert {r for _, r in grown(spark, directory, [left, right])} == {"l0", "r0"}
    region_map.add_events(spark, directory, frame(spark, bridge))
    assert {r.region for r in region_map.map_regions(spark, directory).collect()} == {"a"}
    # The version before still has two.
    assert {r.region for r in region_map.map_regions(spark, directory, 3).collect()} == {"l0", "r0"}
    before = rows(region_map.map_regions(spark, directory))
    region_map.add_events(spark, directory, frame(spark, left))  # the same again changes nothing
    assert rows(region_map.map_regions(spark, directory)) == before
    region_map.add_events(spark, directory, frame(spark, {"far": (10.0, 10.0)}))
    assert ("far", "far") in rows(region_map.map_regions(spark, directory))


def test_only_pairs_of_changed_cubes_are_looked_at(spark, folder, monkeypatch):
    rng = random.Random(8)
    old = {f"o{k}": (40 + rng.uniform(0, 12), rng.uniform(0, 16)) for k in range(150)}
    directory = f"{folder}/map"
    grown(spark, directory, [old])
    new = {"n1": (45.0, 8.0), "n2": (45.2, 8.1)}
    changed = {r.root for r in regions.in_cubes(frame(spark, new), 50.0).collect()}
    looked, opened = [], set()
    judged, read = regions._judged, versions.read_part

    def noted(pairs, radius):
        looked.extend((r.a_root, r.b_root) for r in pairs.select("a_root", "b_root").collect())
        return judged(pairs, radius)

    def listed(spark, directory, table, parts=None):
        found = read(spark, directory, table, parts)
        if "tile" in found.columns:
            opened.update(found.inputFiles())
        return found

    monkeypatch.setattr(regions, "_judged", noted)
    monkeypatch.setattr(versions, "read_part", listed)
    region_map.add_events(spark, directory, frame(spark, new))
    monkeypatch.undo()
    assert looked and all(a in changed or b in changed for a, b in looked)
    tiles = versions.current(spark, directory, 2).tables["places"].parts
    assert 0 < len({f.rsplit("/", 2)[1] for f in opened}) < len(tiles) / 2
    want = regions.geo_regions(frame(spark, old | new))
    assert rows(region_map.map_regions(spark, directory), "competition_id", "region") == rows(want, "competition_id", "region")


def test_a_small_radius_and_an_empty_map(spark, folder):
    with pytest.raises(ValueError):
        region_map.create_map(spark, f"{folder}/no", 0.001)
    assert grown(spark, f"{folder}/empty", [{}]) == []
    places = {f"p{k}": (50 + k * 1e-3, 20.0) for k in range(30)}  # 111 m apart
    want = rows(regions.geo_regions(frame(spark, places), 0.12, 1), "competition_id", "region")
    batches = [dict(list(places.items())[k::2]) for k in range(2)]
    assert grown(spark, f"{folder}/fine", batches, 0.12, pair_budget=1) == want
    with pytest.raises(ValueError):
        region_map.add_events(spark, f"{folder}/none", frame(spark, places))
    with pytest.raises(ValueError):
        region_map.create_map(spark, f"{folder}/fine", 0.12)
