"""Steps whose work must grow no faster than their input, held against plain pairs on small tables."""

import pyspark.sql.functions as F

from haulgraph.operators import spatial as X


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distance_join_sends_no_side_whole_and_spreads_its_pairs(spark):
    side = lambda s, n: spark.range(n).select(F.col("id").alias(f"{s}_id"), (F.col("id") % 90).cast("double").alias(f"{s}_lat"), (F.col("id") % 170).cast("double").alias(f"{s}_lon"))
    pairs = X.within_distance(side("l", 300), side("r", 200), 500_000.0)
    assert "Broadcast" not in plan(pairs) and plan(pairs).count("REPARTITION_BY_NUM") == 2
    every = side("l", 300).crossJoin(side("r", 200)).withColumn("d", X.haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))).filter("d <= 500000")
    assert sorted(map(tuple, pairs.select("l_id", "r_id").collect())) == sorted(map(tuple, every.select("l_id", "r_id").collect()))


def test_nearest_cell_does_not_send_multiplied_rows(spark):
    points = spark.createDataFrame([(1, 10.1, 20.1), (2, -3.9, 7.3)], "id long, lat double, lon double")
    cells = spark.createDataFrame([(5, 10.25, 20.25), (6, 10.0, 20.0), (7, 50.0, 0.0)], "cell long, cell_lat double, cell_lon double")
    found = X.nearest_cell(points, cells)
    assert "Broadcast" not in plan(found)
    assert [(r.id, r.cell) for r in found.collect()] == [(1, 6)]


def test_nearest_sites_by_widening_squares(spark, tmp_path):
    from haulgraph.plans.graphs import Written

    points = [(i, (i * 37 % 101) / 2.0, (i * 53 % 89) / 3.0, i % 3) for i in range(60)]
    sites = [(i, (i * i * 7 % 97) / 2.0, (i * 29 % 83) / 3.0, i % 2 * 2) for i in range(40)] + [(99, 500.0, 900.0, 1)]
    schema = "lat double, lon double, land int"
    got = X.nearest_planar(spark.createDataFrame(points, f"id int, {schema}"), spark.createDataFrame(sites, f"site int, {schema}"), "land", 4, Written(spark))
    expected = []
    for i, a, b, land in points:
        near = sorted((abs(a - x) + abs(b - y), s) for s, x, y, other in sites if other == land)[:4]
        expected += [(i, s) for _, s in near]
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_two_least_offers_along_a_line(spark):
    from haulgraph.operators.prefix import two_least

    at = [(g, x / 4.0) for g in (1, 2, 3) for x in range(-8, 9)]
    offers = [(1 + i % 2, (i * 7 % 11) / 2.0 - 2.5, i * 5 % 4, i) for i in range(23)] + [(3, 0.5, 1, 77)]
    got = two_least(spark.createDataFrame(at, "g int, x double"), spark.createDataFrame(offers, "g int, x double, value int, name int"), ["g"], "x", 0.5)
    for r in got.collect():
        every = sorted((v + abs(r.x - x) * 0.5, n) for g, x, v, n in offers if g == r.g)
        assert [round(b["cost"], 9) for b in r.best] == [round(c, 9) for c, _ in every[:2]] and len({b["name"] for b in r.best}) == len(r.best)
    assert got.count() == len(at)


def costs(edges, source):
    best, todo = {source: 0.0}, [source]
    while todo:
        at = todo.pop()
        for s, t, c in edges:
            if s == at and best[at] + c < best.get(t, 1e18):
                best[t] = best[at] + c
                todo.append(t)
    return best


def test_shortest_takes_few_rounds_on_chains_and_crosses_cores(spark, monkeypatch):
    from haulgraph.plans import graphs as G

    written, plain = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: written.append(1) or plain(df))
    chain = [(i, i + 1, float(i % 3 + 1)) for i in range(60)] + [(i + 1, i, float(i % 5 + 1)) for i in range(60)]
    # a core of five nodes, each beside all others, one way dearer; a tail that is only left
    core = [(100 + i, 100 + j, float((i * 7 + j * 3) % 11 + 1)) for i in range(5) for j in range(5) if i != j] + [(60, 102, 2.0), (104, 200, 1.0), (200, 201, 1.0)]
    edges = chain + core
    got = G.shortest(spark.createDataFrame(edges, "src int, dst int, cost double"), spark.createDataFrame([(0, 0), (103, 103)], "source int, node int"))
    assert {(r.source, r.node): r.cost for r in got.collect()} == {(s, n): c for s in (0, 103) for n, c in costs(edges, s).items()}
    assert len(written) < 100  # two a node before


def test_fewest_hops_takes_the_least_of_equal_paths(spark, monkeypatch):
    from haulgraph.plans import graphs as G

    written, plain = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: written.append(1) or plain(df))
    edges = [(1, 5), (1, 3), (5, 9), (3, 9), (9, 2), (2, 1)] + [(20 + i, 21 + i) for i in range(60)] + [(9, 20)]
    got = {r.node: r.path for r in G.fewest_hops(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(1, 1)], "source int, node int")).collect()}
    assert got[9] == [1, 3, 9] and got[2] == [1, 3, 9, 2] and got[80] == [1, 3, 9, *range(20, 81)] and got[1] == [1]
    assert len(written) < 100


def test_voronoi_reach_follows_density(spark, monkeypatch):
    import inspect

    from haulgraph.plans.cells import voronoi
    from haulgraph.plans.graphs import Written

    assert inspect.signature(voronoi).parameters["reach"].default is None
    sites = spark.createDataFrame([(i, 0, (i * 37 % 101) / 101.0 * 30, (i * 61 % 97) / 97.0 * 12) for i in range(90)], "site int, land int, lon double, lat double")
    ring = [(0.0, 0.0), (30.0, 0.0), (30.0, 12.0), (0.0, 12.0), (0.0, 0.0)]
    lands = spark.createDataFrame([(0, ring)], "land int, ring array<struct<lon: double, lat: double>>")
    own, wide = (sorted((r.site, sorted((round(p.lon, 6), round(p.lat, 6)) for p in set(r.ring))) for r in voronoi(sites, lands, Written(spark), **reach).collect()) for reach in ({}, {"reach": 100.0}))
    assert own == wide and len(own) == 90


def test_gaps_close_by_growing_reach_as_by_all_lines(spark, tmp_path):
    from haulgraph.plans import lines as L
    from haulgraph.plans.graphs import Written

    ends = [(2 * g + o, g, (g * 37 % 101) / 4.0, (g * 61 % 97) / 2.0 + o * 0.3) for g in range(120) for o in (0, 1)]
    df = spark.createDataFrame(ends, "id long, graph long, lat double, lon double")
    side = lambda s: df.toDF(f"{s}_id", f"{s}_graph", f"{s}_lat", f"{s}_lon")
    pairs = X.within_distance(side("l"), side("r"), 900_000.0).filter("l_id < r_id and l_graph <> r_graph").select("distance_m", "l_id", "r_id", "l_graph", "r_graph").collect()
    root, expected = {g: g for g in range(120)}, []
    for d, a, b, g, h in sorted(map(tuple, pairs)):
        if root[g] != root[h]:
            expected.append((a, b, d))
            old = root[h]
            root = {k: root[g] if v == old else v for k, v in root.items()}
    assert sorted(map(tuple, L.close_gaps(df, 900_000.0, Written(spark)).collect())) == sorted(expected)


def test_nearest_within_a_limit_by_growing_radius(spark):
    from haulgraph.plans.graphs import Written

    side = lambda s, n, k: spark.range(n).select(F.col("id").alias(f"{s}_id"), (F.col("id") * k % 83).cast("double").alias(f"{s}_lat"), (F.col("id") * k % 167).cast("double").alias(f"{s}_lon"))
    every = X.within_distance(side("l", 150, 37), side("r", 60, 53), 900_000.0).groupBy("l_id").agg(F.min(F.struct("distance_m", "r_id")).alias("m")).select("l_id", "m.r_id", "m.distance_m")
    got = X.nearest_within(side("l", 150, 37), side("r", 60, 53), 900_000.0, Written(spark))
    assert sorted(map(tuple, got.select("l_id", "r_id", "distance_m").collect())) == sorted(map(tuple, every.collect()))


def test_ends_tied_by_squares_as_by_all_pairs(spark):
    from haulgraph.plans import lines as L
    from haulgraph.plans.graphs import Written, components

    ends = spark.range(400).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("end"), (F.col("id") * 37 % 101 / 8.0 - 6).alias("lat"), (F.pmod(F.col("id") * 61 % 97 / 12.0 - 184, F.lit(360.0)) - 180).alias("lon"))
    side = lambda s: ends.toDF(f"{s}_id", f"{s}_lat", f"{s}_lon")
    for snap in (14_000.0, 25_000.0):
        pairs = X.within_distance(side("l"), side("r"), snap).filter("l_id < r_id").select(F.col("l_id").alias("src"), F.col("r_id").alias("dst"))
        plain = ends.select("end").join(components(pairs).withColumnRenamed("node", "end"), "end", "left").select("end", F.coalesce("root", "end"))
        assert sorted(map(tuple, L.tied(ends, snap, Written(spark)).collect())) == sorted(map(tuple, plain.collect()))


def test_equal_intervals_do_not_join_neighbouring_unions(spark):
    from haulgraph.plans.results import merge_intervals

    rows = [(1, 75, 80), (1, 75, 80), (1, 81, 85), (1, 80, 81), (1, 86, 87), (1, 86, 87), (1, 87, 92)]
    assert sorted(map(tuple, merge_intervals(spark.createDataFrame(rows, "k int, a int, b int")).collect())) == [(1, 75, 85), (1, 86, 92)]
