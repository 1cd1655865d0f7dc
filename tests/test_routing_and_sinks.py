"""The state rules of the routing search on a hand-made network, and the sinks."""

import json
import os

import pytest

from haulgraph.plans import graphs as G
from haulgraph.plans import routing as R
from haulgraph.sources import files


def tables(spark, **rows):
    kinds = {
        "conversions": "node long, commodity long, to long, fee double, efficiency double", "segments": "node long, dst long, commodity long, network string, fee double, loss double",
        "transfers": "node long, dst long", "connectors": "node long, dst long, commodity long, fee double", "ships": "node long, dst long, commodity long, fee double, loss double",
    }
    return {k: spark.createDataFrame(rows.get(k, []), t) for k, t in kinds.items()}


def arrivals(spark, goals, prune=True, **rows):
    seeds = spark.createDataFrame([(1, 0, 0, 10.0)], "start_id long, node long, commodity long, cost double")
    at = spark.createDataFrame([(g,) for g in goals], "node long")
    best = R.fixpoint(seeds, tables(spark, **rows), at, prune)
    return {r.node: round(r.m, 6) for r in best.join(at, "node").groupBy("node").agg({"cost": "min"}).withColumnRenamed("min(cost)", "m").collect()}


def test_no_two_connectors_in_a_row(spark):
    roads = [(0, 1, 0, 1.0), (1, 2, 0, 1.0)]
    assert arrivals(spark, [2], connectors=roads) == {}
    assert arrivals(spark, [2], connectors=roads[:1], segments=[(1, 2, 0, "A", 3.0, 0.0)]) == {2: 14.0}


def test_one_ship_at_most(spark):
    lanes = [(0, 1, 0, 1.0, 0.5), (1, 2, 0, 1.0, 0.0)]
    assert arrivals(spark, [1, 2], prune=False, ships=lanes) == {1: 22.0}


def test_a_network_is_entered_once(spark):
    rows = {"segments": [(0, 1, 0, "A", 1.0, 0.0), (2, 3, 0, "A", 1.0, 0.0), (1, 4, 0, "A", 1.0, 0.0)], "transfers": [(1, 2)]}
    assert arrivals(spark, [3, 4], prune=False, **rows) == {4: 12.0}  # back into A from another network is not allowed


@pytest.mark.parametrize("prune", [True, False])
def test_long_chains_run_to_their_end_and_bounds_lose_nothing(spark, prune):
    chain = [(k, k + 1, c, "A", 1.0, 0.0) for k in range(12) for c in (0, 1)]
    rows = {"segments": chain, "conversions": [(3, 0, 1, 0.5, 1.0), (5, 1, 0, 0.5, 1.0)], "connectors": [(0, 12, 0, 30.0)]}
    assert arrivals(spark, [12], prune, **rows) == {12: 22.0}


def test_paths_of_fewest_hops_and_contraction(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 5)], "src long, dst long")
    found = G.fewest_hops(edges, spark.createDataFrame([(1, 1)], "source long, node long"))
    assert {r.node: (r.hops, r.path) for r in found.collect()}[5] == (3, [1, 2, 3, 5])
    lines = spark.createDataFrame([(1, 2, 1.0), (2, 3, 9.0), (1, 3, 8.0), (3, 4, 2.0), (4, 4, 1.0)], "src long, dst long, distance_m double")
    assert [tuple(r) for r in G.contract(lines, 5.0).collect()] == [(1, 3, 8.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 2), ("b", 1), ("a", 1)], "graph_id string, x int")
    assert files.partitioned(df, "graph_id", path=f"{tmp_path}/p").filter("graph_id = 'a'").count() == 2
    assert {"graph_id=a", "graph_id=b"} <= set(os.listdir(f"{tmp_path}/p"))
    for scenario in ("s1", "s2", "s2"):
        files.append_status(df, f"{tmp_path}/status", scenario)
    assert spark.read.parquet(f"{tmp_path}/status").filter("scenario = 's2'").count() == 6
    files.snapshot(df, f"{tmp_path}/snap", "x")
    files.snapshot(df.limit(1), f"{tmp_path}/snap", "x")
    assert spark.read.parquet(f"{tmp_path}/snap").count() == 1
    files.append_events(spark, f"{tmp_path}/log", [{"event": "a", "runtime_s": float("inf")}])
    files.append_events(spark, f"{tmp_path}/log", [{"event": "b", "runtime_s": 1.5}])
    files.append_events(spark, f"{tmp_path}/log", [])
    assert sorted(json.loads(r.value)["event"] for r in spark.read.text(f"{tmp_path}/log").collect()) == ["a", "b"]
    files.write_adjacency(df, f"{tmp_path}/adjacency", "graph_id", "x")
    assert {r.graph_id: r.others for r in spark.read.json(f"{tmp_path}/adjacency").collect()} == {"a": [1, 2], "b": [1]}
    assert not files.finished(spark, str(tmp_path))
    files.finish(spark, str(tmp_path))
    assert files.finished(spark, str(tmp_path))
