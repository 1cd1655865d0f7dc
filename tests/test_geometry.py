"""Lines, gaps, shared stretches, nearest polygons and running sums against brute force."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from haulgraph.functions import geo
from haulgraph.operators.polygons import nearest_polygon
from haulgraph.operators.prefix import running_sums
from haulgraph.plans import lines as L
from haulgraph.plans import results
from haulgraph.plans.graphs import Written

POINTS = "array<struct<lon: double, lat: double>>"


def arc(a, b):
    """Metres between (lon, lat) points."""
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(math.sqrt(min(h, 1)))


def test_pieces_lie_on_the_line_and_add_up(spark):
    rng = random.Random(1)
    lines = {k: [(rng.uniform(-179, 179), rng.uniform(-65, 65))] for k in range(20)}
    for points in lines.values():
        for _ in range(rng.randint(1, 6)):
            x, y = points[-1]
            points.append(((x + rng.uniform(-1, 1) + 180) % 360 - 180, y + rng.uniform(-1, 1)))
    lines |= {90: [(179.5, 0.0), (-179.5, 0.0)], 91: [(1.0, 1.0), (1.0, 1.0)], 92: [(1.0, 1.0)], 93: None, 94: [(0.0, 0.0), (0.0, 0.1), (0.0, 0.1), (0.0, 0.2)]}
    df = spark.createDataFrame(list(lines.items()), f"line_id long, points {POINTS}")
    got = collections.defaultdict(list)
    for r in sorted(L.pieces(df, 40_000.0).collect(), key=lambda r: r.piece):
        got[r.line_id].append(r)
    assert not {91, 92, 93} & set(got) and set(got) == set(range(20)) | {90, 94}
    for k, parts in got.items():
        whole = sum(arc(a, b) for a, b in zip(lines[k], lines[k][1:], strict=False))
        assert sum(p.length_m for p in parts) == pytest.approx(whole) and [p.piece for p in parts] == list(range(len(parts)))
        assert all(p.length_m == pytest.approx(40_000.0) for p in parts[:-1]) and parts[-1].length_m <= 40_000.0 + 1e-6
        assert tuple(parts[0].points[0]) == lines[k][0] and tuple(parts[-1].points[-1]) == pytest.approx(lines[k][-1])
        assert all(tuple(a.points[-1]) == tuple(b.points[0]) for a, b in zip(parts, parts[1:], strict=False))
        for p in parts:
            assert sum(arc(a, b) for a, b in zip(p.points, p.points[1:], strict=False)) == pytest.approx(p.length_m, rel=5e-3)
    assert all(abs(abs(x.lon) - 180) <= 0.5 for p in got[90] for x in p.points)


def test_line_texts(spark):
    texts = ["LINESTRING (1 2, 3.5 -4)", " linestring(0 0,1 1,2 0) ", "POINT (1 2)", "--", None, "LINESTRING EMPTY"]
    got = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(L.points_of(F.col("t")).alias("p")).collect()]
    assert [[tuple(p) for p in x] if x else x for x in got] == [[(1.0, 2.0), (3.5, -4.0)], [(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)], None, None, None, None]
    df = spark.createDataFrame([([(1.0, 2.0), (3.5, -4.0)],)], f"p {POINTS}")
    assert df.select(L.wkt_of(F.col("p"))).first()[0] == "LINESTRING (1.0 2.0, 3.5 -4.0)"


def test_network_joins_ends_and_drops_parallels(spark):
    rows = [([(0.0, 0.0), (0.5, 0.0)], 1.0), ([(0.5001, 0.0), (1.0, 0.0)], 2.0), ([(0.5, 0.0), (0.5, 0.2), (1.0, 0.0)], 9.0), ([(20.0, 0.0), (21.0, 0.0)], 4.0), ([(0.0, 0.0), (0.00001, 0.0)], 0.1)]
    nodes, edges = L.network(spark.createDataFrame(rows, f"points {POINTS}, length_m double"), 100.0, Written(spark))
    assert sorted((r.src, r.dst, r.graph, r.distance_m) for r in edges.collect()) == [("0.0 0.0", "0.5 0.0", "0.0 0.0", 1.0), ("0.5 0.0", "1.0 0.0", "0.0 0.0", 2.0), ("20.0 0.0", "21.0 0.0", "20.0 0.0", 4.0)]
    assert sorted((r.node, r.graph) for r in nodes.collect()) == [("0.0 0.0", "0.0 0.0"), ("0.5 0.0", "0.0 0.0"), ("1.0 0.0", "0.0 0.0"), ("20.0 0.0", "20.0 0.0"), ("21.0 0.0", "20.0 0.0")]


@pytest.mark.parametrize("seed", [1, 2])
def test_closed_gaps_are_a_least_spanning_forest(spark, seed):
    rng = random.Random(seed)
    ends = [(k, k // 2 % 40, rng.uniform(-3, 3), rng.choice([0.0, 179.0]) + rng.uniform(-3, 3)) for k in range(120)]
    ends = [(k, g, lat, (lon + 180) % 360 - 180) for k, g, lat, lon in ends]
    limit, root, want = 90_000.0, {g: g for _, g, *_ in ends}, []

    def find(g):
        return g if root[g] == g else find(root[g])

    pairs = sorted((math.ceil(arc((a[3], a[2]), (b[3], b[2]))), a[0], b[0], a[1], b[1]) for a in ends for b in ends if a[0] < b[0] and a[1] != b[1])
    for m, a, b, g, h in pairs:
        if m <= limit and find(g) != find(h):
            root[find(g)] = find(h)
            want.append((a, b, float(m)))
    got = L.close_gaps(spark.createDataFrame(ends, "id long, graph long, lat double, lon double"), limit, Written(spark))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 10


def test_no_gaps_to_close(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 1, 0.0, 0.001), (3, 2, 50.0, 0.0)], "id long, graph long, lat double, lon double")
    assert L.close_gaps(df, 1000.0, Written(spark)).collect() == [] and L.close_gaps(df.limit(0), 1000.0, Written(spark)).collect() == []


def test_shared_stretches_keep_length_times_routes(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, None]), a, a + rng.randint(-1, 9)) for a in (rng.randint(0, 60) for _ in range(300))]
    got = L.shared_stretches(spark.createDataFrame(rows, "k long, a long, b long"), Written(spark)).collect()
    cover = collections.Counter((k, x) for k, a, b in rows for x in range(a, b))
    assert {(r.k, x): r.routes for r in got for x in range(r.a, r.b)} == dict(cover)
    assert sum((r.b - r.a) * r.routes for r in got) == sum(max(b - a, 0) for _, a, b in rows)


def test_running_sums_of_a_key_over_many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(2)
        rows = [(rng.choice(["hot", "hot", "hot", "x", None]), k, rng.choice([1, 2, None])) for k in range(2000)]
        df = spark.createDataFrame(rows, "k string, at long, q long")
        keep = Written(spark)
        dealt = running_sums(df, ["k"], ["at"], {"total": "q"}, keep)
        want, run = {}, collections.Counter()
        for k, at, q in sorted(rows, key=lambda r: r[1]):
            run[k] += q or 0
            want[at] = run[k]
        assert {r["at"]: r.total for r in dealt.collect()} == want
        curve = results.supply_curve(df, ["k"], "at", "at", "q", keep).collect()
        assert all(r.begins == want[r["at"]] - r.q for r in curve if r.q is not None)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def to_arc(p, a, b, n=4000):
    """The least distance to points along the arc between a and b."""
    v = lambda q: (math.cos(math.radians(q[1])) * math.cos(math.radians(q[0])), math.cos(math.radians(q[1])) * math.sin(math.radians(q[0])), math.sin(math.radians(q[1])))
    x, y, z = v(a), v(b), v(p)
    w = math.acos(max(-1, min(1, sum(s * t for s, t in zip(x, y, strict=True)))))
    best = math.inf
    for k in range(n + 1):
        f, g = (math.sin((1 - k / n) * w) / math.sin(w), math.sin(k / n * w) / math.sin(w)) if w > 1e-9 else (1, 0)
        c = [f * s + g * t for s, t in zip(x, y, strict=True)]
        best = min(best, math.dist(c, z))
    return 2 * geo.EARTH_M * math.asin(min(1, best / 2))


def test_nearest_polygon_over_date_line_and_pole(spark):
    rings = {1: [(170.0, -5.0), (179.0, -5.0), (179.0, 5.0), (170.0, 5.0), (170.0, -5.0)], 2: [(-20.0, 80.0), (100.0, 84.0), (-140.0, 86.0), (-20.0, 80.0)], 3: [(0.0, 0.0), (40.0, 0.0), (40.0, 10.0), (0.0, 10.0), (0.0, 0.0)], 4: [(40.0, 0.0), (50.0, 0.0), (50.0, 10.0), (40.0, 10.0), (40.0, 0.0)], 5: [(7.0, 70.0)]}
    rng = random.Random(3)
    points = [(k, rng.uniform(-8, 8), (rng.uniform(165, 190) + 180) % 360 - 180) for k in range(40)] + [(100 + k, rng.uniform(76, 90), rng.uniform(-180, 180)) for k in range(30)] + [(200 + k, rng.uniform(-6, 16), rng.uniform(-6, 56)) for k in range(60)] + [(300, -0.5, 40.0), (301, 60.0, 60.0)]
    polygons = spark.createDataFrame(list(rings.items()), f"land long, ring {POINTS}")
    limit = 400_000.0
    got = {r.id: (r.land, r.distance_m) for r in nearest_polygon(spark.createDataFrame(points, "id long, lat double, lon double"), polygons, "land", limit).collect()}
    for k, lat, lon in points:
        far = {land: min((to_arc((lon, lat), a, b) for a, b in zip(r, r[1:], strict=False)), default=math.inf) for land, r in rings.items()}
        if k in got and got[k][1] == 0:
            land = rings[got[k][0]]
            assert min(x for x, _ in land) <= lon <= max(x for x, _ in land)
            continue
        near = min(far.values())
        assert (k in got) == (near <= limit) or abs(near - limit) < 2000
        if k in got:
            assert got[k][1] == pytest.approx(near, abs=1500) and far[got[k][0]] == pytest.approx(near, abs=1500)
    assert got[300][0] == 3 and 301 not in got and sum(m == 0 for _, m in got.values()) > 20


def test_lengths_and_extents(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 180.0), (10.0, 20.0, 10.0, 20.0), (89.0, 0.0, 89.0, 180.0)], "a double, b double, c double, d double")
    got = [r.m for r in df.select(geo.arc_m(*map(F.col, "abcd")).alias("m")).collect()]
    assert got == pytest.approx([math.pi * geo.EARTH_M, 0.0, math.radians(2) * geo.EARTH_M])
    pad = spark.createDataFrame([(0.0, 100.0), (5.0, 5.0)], "low double, high double").select(*(c.alias(n) for c, n in zip(geo.pad_extent(F.col("low"), F.col("high")), "xy", strict=True)))
    assert [tuple(r) for r in pad.collect()] == [(-3.0, 103.0), (4.0, 6.0)]
    assert [r.w for r in spark.createDataFrame([(190.0,), (-180.0,), (-200.5,), (180.0,)], "x double").select(geo.wrap(F.col("x")).alias("w")).collect()] == [-170.0, -180.0, 159.5, 180.0]
