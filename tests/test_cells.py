"""Voronoi cells and unions on hand-made and random areas."""

import math
import random

import pytest
from pyspark.sql import functions as F

from haulgraph.plans import cells
from haulgraph.plans.graphs import Written

RING = "array<struct<lon: double, lat: double>>"


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def inside(p, ring):
    return sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:], strict=False)) % 2 == 1


def square(x, y, w=1.0, h=1.0):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


LANDS = {1: square(0.0, 0.0, 20.0, 10.0), 2: [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 3.0), (0.0, 10.0), (0.0, 0.0)], 3: square(50.0, 50.0, 4.0, 4.0), 4: square(60.0, 0.0), 5: square(-9.0, -9.0, 2.0, 2.0)}


@pytest.mark.parametrize("reach", [0.7, 50.0])
def test_cells_cover_the_land_and_hold_what_is_nearest(spark, reach):
    rng = random.Random(1)
    sites = [(k, 1, rng.uniform(0, 3 if k % 2 else 20), rng.uniform(0, 10)) for k in range(25)] + [(100 + k, 2, rng.uniform(0, 10), rng.uniform(0, 2.9)) for k in range(6)]
    sites += [(200, 3, 51.0, 51.0), (300, 4, 60.2, 0.5), (301, 4, 60.8, 0.5), (302, 4, 60.8, 0.5), (7, 99, 0.0, 0.0)]
    keep = Written(spark)
    lands = spark.createDataFrame(list(LANDS.items()), f"land long, ring {RING}")
    got = cells.voronoi(spark.createDataFrame(sites, "site long, land long, lon double, lat double"), lands, keep, reach).collect()
    held = {(r.land, r.site): [tuple(p) for p in r.ring] for r in got}
    assert set(held) == {(land, s) for s, land, *_ in sites if s != 302 and land != 99} and len(got) == len(held)
    for land in (1, 2, 3, 4):
        assert sum(abs(area(r)) for (g, _), r in held.items() if g == land) == pytest.approx(abs(area(LANDS[land])))
    assert abs(area(held[4, 300])) == pytest.approx(0.5) and held[3, 200] == LANDS[3]
    for _ in range(300):
        land = rng.choice([1, 2])
        p = rng.uniform(0, 20 if land == 1 else 10), rng.uniform(0, 10)
        if inside(p, LANDS[land]):
            near = min((s for s in sites if s[1] == land), key=lambda s: math.dist(p, s[2:]))
            assert [s for (g, s), r in held.items() if g == land and inside(p, r)] == [near[0]]


def test_no_sites_or_no_lands(spark):
    lands = spark.createDataFrame(list(LANDS.items()), f"land long, ring {RING}")
    none = spark.createDataFrame([], "site long, land long, lon double, lat double")
    assert cells.voronoi(none, lands, Written(spark)).collect() == []
    assert cells.voronoi(spark.createDataFrame([(1, 1, 0.0, 0.0)], none.schema), lands.limit(0), Written(spark)).collect() == []


def unions(spark, rows):
    got = cells.union(spark.createDataFrame(rows, f"land long, ring {RING}"), Written(spark)).collect()
    return {(r.land, r.part): [tuple(p) for p in r.ring] for r in got}


def test_union_has_no_inner_sides(spark):
    rng = random.Random(2)
    block = [(x, y) for x in range(9) for y in range(7)]
    kept = [c for c in block if rng.random() < 0.75]
    rows = [(1, [(float(a), float(b)) for a, b in (square(*c) if rng.random() < 0.5 else square(*c)[::-1])]) for c in kept] + [(2, square(0.0, 0.0, 3.0, 3.0)), (2, square(3.0, 0.0, 3.0, 3.0)[::-1])]
    held = unions(spark, rows)
    assert sum(area(r) for (g, _), r in held.items() if g == 1) == pytest.approx(len(kept))
    assert sum(len(r) - 1 for (g, _), r in held.items() if g == 1) == sum((x + i, y + j) not in kept for x, y in kept for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)))
    assert all(r[0] == r[-1] and all(math.dist(a, b) == 1 for a, b in zip(r, r[1:], strict=False)) for (g, _), r in held.items() if g == 1)
    for x, y in block:
        assert (sum(inside((x + 0.5, y + 0.5), r) for (g, _), r in held.items() if g == 1) % 2 == 1) == ((x, y) in kept)
    assert [k for k in held if k[0] == 2] == [(2, 1)] and area(held[2, 1]) == 18.0 and len(held[2, 1]) == 7


def test_holes_corners_and_degenerate_rings(spark):
    frame = [(1, square(float(x), float(y))) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    touching = [(2, square(0.0, 0.0)), (2, square(1.0, 1.0))]
    held = unions(spark, [*frame, *touching, (3, [(0.0, 0.0), (1.0, 0.0)]), (3, []), (3, [(0.0, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)])])
    assert sorted(area(r) for (g, _), r in held.items() if g == 1) == [-1.0, 9.0]
    assert [area(r) for (g, _), r in sorted(held.items()) if g == 2] == [1.0, 1.0] and not [k for k in held if k[0] == 3]
    assert unions(spark, []) == {}


def test_signed_area(spark):
    df = spark.createDataFrame([(square(0.0, 0.0, 2.0, 3.0),), (square(0.0, 0.0)[::-1],), ([],), (None,)], f"ring {RING}")
    assert [r.a for r in df.select(cells.signed_area(F.col("ring")).alias("a")).collect()] == [6.0, -1.0, 0.0, 0.0]
