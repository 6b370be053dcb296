"""Distinct persons of spans from bitmaps against counts over the attendance."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.tiny import rows
from turnout.operators import person_bitmaps as bitmaps

ROWS = "person_id string, year int, quarter int"


def attendance(spark, seed=1, n=3000, persons=400):
    rng = random.Random(seed)
    data = [(f"p{rng.randrange(persons)}", rng.randint(2015, 2019), rng.randint(1, 4)) for _ in range(n)]
    data = [r for r in data if (r[1], r[2]) != (2017, 2)]  # a quarter without anybody
    return spark.createDataFrame(data + [("busy", r[1], r[2]) for r in data], ROWS).repartition(5)


def distinct(frame, low, high):
    return frame.where(F.col("year") * 4 + F.col("quarter") - 1 >= low).where(F.col("year") * 4 + F.col("quarter") - 1 <= high).select("person_id").distinct().count()


@pytest.fixture
def rollup(spark):
    frame = attendance(spark)
    numbers = bitmaps.number_persons(frame)
    return frame, numbers, bitmaps.quarter_bitmaps(frame, numbers)


def test_numbers_are_dense_and_stay(spark):
    frame = attendance(spark)
    numbers = bitmaps.number_persons(frame.unionByName(spark.createDataFrame([(None, 2015, 1)], ROWS)))
    known = {r.person_id: r.number for r in numbers.collect()}
    assert sorted(known.values()) == list(range(1, len(known) + 1)) and None not in known
    more = spark.createDataFrame([("new", 2020, 1), ("p1", 2020, 1), ("newer", 2020, 1)], ROWS)
    later = {r.person_id: r.number for r in bitmaps.number_persons(more, numbers).collect()}
    assert {p: later[p] for p in known} == known
    assert sorted(later[p] for p in later if p not in known) == [len(known) + 1, len(known) + 2]
    assert bitmaps.number_persons(frame.limit(0)).count() == 0


def test_spans_are_exact(rollup):
    frame, _, maps = rollup
    for first, last in (((2015, 1), (2019, 4)), ((2016, 3), (2017, 2)), ((2017, 2), (2017, 2)), ((2018, 4), (2018, 4)), ((2019, 1), (2016, 1))):
        want = distinct(frame, first[0] * 4 + first[1] - 1, last[0] * 4 + last[1] - 1)
        assert bitmaps.persons_between(maps, first, last).first().n_persons == want
    rolling = {(r.year, r.quarter): r.n_persons for r in bitmaps.persons_over_quarters(maps, 3).collect()}
    quarters = range(2015 * 4, 2019 * 4 + 4)
    assert rolling == {(k // 4, k % 4 + 1): distinct(frame, k - 2, k) for k in quarters}
    assert rows(bitmaps.persons_per_year(maps)) == [(y, distinct(frame, 4 * y, 4 * y + 3)) for y in range(2015, 2020)]
    assert rows(bitmaps.persons_to_date(maps)) == [(y, distinct(frame, 0, 4 * y + 3)) for y in range(2015, 2020)]
    with pytest.raises(ValueError):
        bitmaps.persons_over_quarters(maps, 0)


def test_batches_add_up(spark, rollup):
    frame, numbers, maps = rollup
    batch = attendance(spark, seed=2, n=500, persons=600)
    both = frame.unionByName(batch)
    more = bitmaps.number_persons(batch, numbers)
    joined = bitmaps.add_bitmaps(maps, bitmaps.quarter_bitmaps(batch, more))
    assert rows(bitmaps.persons_to_date(joined)) == [(y, distinct(both, 0, 4 * y + 3)) for y in range(2015, 2020)]


def test_many_buckets(spark):
    frame = spark.range(100_000).selectExpr("concat('p', id) as person_id", "2015 + cast(id % 2 as int) as year", "1 as quarter")
    maps = bitmaps.quarter_bitmaps(frame, bitmaps.number_persons(frame))
    assert maps.select("bucket").distinct().count() == 4  # of 32,768 persons
    assert rows(bitmaps.persons_per_year(maps)) == [(2015, 50_000), (2016, 50_000)]
    assert bitmaps.persons_between(maps, (2015, 1), (2016, 4)).first().n_persons == 100_000


def test_a_span_reads_the_rollup_only(spark, folder, rollup):
    """A span over a stored rollup opens no attendance; bitmaps are made before the shuffle."""
    _, _, maps = rollup
    plan = maps._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_construct_agg" in plan
    maps.write.parquet(f"{folder}/rollup")
    stored = spark.read.parquet(f"{folder}/rollup")
    span = bitmaps.persons_between(stored, (2016, 1), (2016, 4))
    assert {f.split("/rollup/")[0] for f in span.inputFiles()} == {f"file://{folder}"}
    plan = span._jdf.queryExecution().executedPlan().toString()
    assert "partial_bitmap_or_agg" in plan
