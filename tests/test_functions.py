"""Column functions, operators, readers and the stream on small frames."""

import json
import math

import pytest
from pyspark.sql import functions as F

from haulgraph.functions import cost as C
from haulgraph.functions import geo as G
from haulgraph.operators import spatial, state
from haulgraph.plans import graphs, results, routing
from haulgraph.sources import files
from haulgraph.streaming import events


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_haversine(spark):
    at = lambda *p: value(spark, G.haversine_m(*(F.lit(float(x)) for x in p)))
    assert at(10, 20, 10, 20) == 0
    assert abs(at(52.52, 13.405, 48.8566, 2.3522) - 877_464) < 1500
    assert at(0, 179.5, 0, -179.5) == at(0, 0, 0, 1)


def test_round_quarter_is_even_about_zero(spark):
    assert [value(spark, G.round_quarter(F.lit(x))) for x in (-10.3, 10.3, 0.125)] == [-10.25, 10.25, 0.25]


def test_ship_cost_without_arrival_is_null(spark):
    assert value(spark, C.ship_cost(F.lit(10.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(False))) is None


def test_annuity(spark):
    assert value(spark, C.annuity(F.lit(0.08), F.lit(20))) == pytest.approx(0.101852, abs=1e-6)


def test_missing_price_is_impossible(spark):
    x = C.conversion_cost(F.lit(1.0), F.lit(0.1), F.lit(0.05), F.lit(10.0), F.lit(8000.0), [(F.lit(1.0), F.lit(None).cast("double"))])
    assert value(spark, x) == math.inf


def test_within_distance_equals_brute_force_over_the_date_line_and_poles(spark):
    points = [(0, 0.0, 179.9), (1, 0.1, -179.9), (2, 89.5, 10.0), (3, 89.5, -170.0), (4, -45.0, 3.0), (5, -45.2, 3.1), (6, 60.0, 0.0), (7, 60.0, 1.5)]
    side = lambda s: spark.createDataFrame(points, f"{s}_id long, {s}_lat double, {s}_lon double")
    for limit in (1_000.0, 30_000.0, 120_000.0, 3_000_000.0):
        got = {(r.l_id, r.r_id) for r in spatial.within_distance(side("l"), side("r"), limit).collect()}
        both = side("l").crossJoin(side("r")).withColumn("d", G.haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")))
        assert got == {(r.l_id, r.r_id) for r in both.filter(F.col("d") <= limit).collect()}


def test_keep_best_breaks_ties(spark):
    df = spark.createDataFrame([(1, 5.0, "b"), (1, 5.0, "a"), (2, 1.0, "c")], "k int, cost double, id string")
    assert sorted(r.id for r in state.keep_best(df, ["k"], ["cost", "id"]).collect()) == ["a", "c"]


def test_shortest_and_components(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (7, 8, 1.0)], "src long, dst long, cost double")
    s = spark.createDataFrame([(1, 1)], "source long, node long")
    assert {(r.node, r.cost) for r in graphs.shortest(e, s).collect()} == {(1, 0.0), (2, 1.0), (3, 2.0)}
    chain = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(e.filter("src = 7").select((F.col("src") + 100).alias("src"), (F.col("dst") + 100).alias("dst")))
    roots = {r.node: r.root for r in graphs.components(chain).collect()}
    assert set(roots.values()) == {0, 107} and roots[60] == 0


#: Nine nodes: the smallest case with a known route.
SEGMENTS = [("start", "PG_0", "H2", 0.00311), ("PG_0", "PG_1", "H2", 0.00488), ("PG_1", "s_0", "H2", 0.12662), ("s_0", "s_1", "FTF", 0.00003), ("s_1", "PL_0", "FTF", 0.00024), ("start", "PL_0", "H2", 1e6)]


@pytest.mark.parametrize("prune", [True, False])
def test_nine_nodes(spark, prune):
    segments = spark.createDataFrame([(a, b, c, x, 0.0) for a, b, c, x in SEGMENTS], "src string, dst string, commodity string, fee double, loss double")
    conversions = spark.createDataFrame([("s_0", "H2", "FTF", 81.320844, 0.8323)], "node string, commodity string, to string, fee double, efficiency double")
    seeds = spark.createDataFrame([(1, "start", "H2", 0.0)], "start_id long, node string, commodity string, cost double")
    goals = spark.createDataFrame([("PL_0",)], "node string")
    best = routing.search(seeds, conversions, segments, goals, 10, prune)
    cost = best.filter("node = 'PL_0'").agg(F.min("cost")).first()[0]
    assert cost == pytest.approx(97.8682, abs=1e-3)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "src long, dst long, cost double")
    assert graphs.components(e).count() == 0
    assert results.merge_intervals(spark.createDataFrame([], "k long, a long, b long")).count() == 0
    assert state.both_ways(e, "src", "dst").count() == 0


def test_files(spark, tmp_path):
    assert files.csv_or_empty(spark, str(tmp_path / "none.csv"), "a int").count() == 0
    (tmp_path / "m.csv").write_text("src,A,B\nA,0,10.2\nB,10.2,\n")
    assert {(r.src, r.dst, r.distance_m) for r in files.matrix(spark, str(tmp_path / "m.csv")).collect()} == {("A", "A", 0.0), ("A", "B", 11.0), ("B", "A", 11.0)}
    (tmp_path / "near.json").write_text(json.dumps({"a": ["b", "c"], "d": []}))
    assert {(r.node, r.other) for r in files.adjacency(spark, str(tmp_path / "near.json")).collect()} == {("a", "b"), ("a", "c")}
    (tmp_path / "log.jsonl").write_text('{"location": "1", "runtime_s": 0.5, "details": {"a": "b"}}\n')
    assert files.event_log(spark, str(tmp_path / "log.jsonl")).first()["details"] == {"a": "b"}
    (tmp_path / "p.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"name": "x"}}]}))
    assert files.geojson_points(spark, str(tmp_path / "p.geojson")).first()["lat"] == 2.5
    assert files.safe_name("a/b c?.csv") == "a_b_c_.csv"


def test_stream_equals_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=7 * i), i % 3, "click" if i % 2 else "view", float(i), "{}") for i in range(50)]
    batch = spark.createDataFrame(rows, events.SCHEMA)
    batch.write.parquet(str(tmp_path / "in"))
    query = events.summary(events.source(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = batch.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)), F.max("value")).collect()
    assert sorted(tuple(r)[1:] for r in spark.table("seen").collect()) == sorted(tuple(r)[1:] for r in want)


@pytest.mark.parametrize("prune", [True, False])
def test_search_without_a_limit_reaches_the_fixpoint(spark, prune):
    """A chain longer than the queries' four steps, and a dear short cut, against Bellman-Ford."""
    steps = [(i, i + 1, 0, 1.0 + i % 3, 0.01) for i in range(8)] + [(0, 8, 0, 90.0, 0.0)]
    turns = [(3, 0, 1, 2.0, 0.8), (8, 0, 1, 5.0, 0.9)]
    want = {(0, 0): 10.0}
    while True:
        new = dict(want)
        for a, b, c, fee, loss in steps:
            if (a, c) in new:
                new[b, c] = min(new.get((b, c), math.inf), (new[a, c] + fee) / (1 - loss))
        for n, c, to, fee, share in turns:
            if (n, c) in new:
                new[n, to] = min(new.get((n, to), math.inf), (new[n, c] + fee) / share)
        if new == want:
            break
        want = new
    seeds = spark.createDataFrame([(1, 0, 0, 10.0)], "start_id long, node long, commodity long, cost double")
    segments = spark.createDataFrame(steps, "src long, dst long, commodity long, fee double, loss double")
    conversions = spark.createDataFrame(turns, "node long, commodity long, to long, fee double, efficiency double")
    goals = spark.createDataFrame([(8,)], "node long")
    got = {(r.node, r.commodity): r.cost for r in routing.search(seeds, conversions, segments, goals, prune=prune).collect()}
    assert got[8, 0] == pytest.approx(want[8, 0]) and want[8, 0] < 90
    assert prune or got == pytest.approx(want)
