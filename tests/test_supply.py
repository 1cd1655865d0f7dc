"""The search with routes: the nine-node case, random networks against an exhaustive walk, bounds, incumbents and results."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from haulgraph.plans import results, supply
from haulgraph.plans.graphs import Written

KINDS = {
    "conversions": "node {0}, commodity {1}, to {1}, fee double, efficiency double", "segments": "node {0}, dst {0}, commodity {1}, network string, fee double, loss double",
    "transfers": "node {0}, dst {0}", "connectors": "node {0}, dst {0}, commodity {1}, fee double", "ships": "node {0}, dst {0}, commodity {1}, fee double, loss double",
}


def steps(spark, node="long", commodity="long", **rows):
    return supply.moves({k: spark.createDataFrame(rows.get(k, []), t.format(node, commodity)) for k, t in KINDS.items()})


def run(spark, rows, seeds, goals, prune=True):
    keep = Written(spark)
    s = spark.createDataFrame(seeds, "start_id long, node long, commodity long, cost double")
    g = spark.createDataFrame(goals, "node long, commodity long, price double")
    found = supply.search(s, keep.cut(steps(spark, **rows)), g, prune, keep)
    return found, [r.asDict(recursive=True) for r in supply.routes(found, supply.cheapest(found), keep).collect()]


def flat(rows):
    """Every step as (node, commodity, dst, to, kind, network, fee, share)."""
    held = sorted({c for t in ("conversions", "segments", "connectors", "ships") for r in rows.get(t, []) for c in ((r[1], r[2]) if t == "conversions" else (r[2],))})
    out = [(n, c, n, to, "conversion", None, f, e) for n, c, to, f, e in rows.get("conversions", [])]
    out += [(a, c, b, c, "network", g, f, 1 - x) for a, b, c, g, f, x in rows.get("segments", [])]
    out += [(a, c, b, c, "transfer", None, 0.0, 1.0) for a, b in rows.get("transfers", []) for c in held]
    out += [(a, c, b, c, "connector", None, f, 1.0) for a, b, c, f in rows.get("connectors", [])]
    return out + [(a, c, b, c, "ship", None, f, 1 - x) for a, b, c, f, x in rows.get("ships", [])]


def walk(rows, seeds, goals):
    """The least net cost of each start over all routes that keep the rules, whatever they pass: states hold everything."""
    moves, price = flat(rows), {(n, c): p for n, c, p in goals}
    best = {}
    for start, node, commodity, cost in seeds:
        seen, front, least = {}, [(node, commodity, True, False, frozenset(), None, cost)], math.inf
        while front:
            nxt = []
            for n, c, free, shipped, visited, riding, x in front:
                if (n, c) in price:
                    least = min(least, x - price[n, c])
                for a, k, b, to, kind, network, fee, share in moves:
                    if (a, k) != (n, c) or (kind == "connector" and not free) or (kind == "ship" and shipped) or (kind == "network" and network != riding and network in visited):
                        continue
                    state = (b, to, False if kind == "connector" else kind in ("network", "ship") or free, shipped or kind == "ship", visited | {network} if kind == "network" else visited, network if kind == "network" else riding if kind == "conversion" else None)
                    y = (x + fee) / share
                    if y < seen.get(state, math.inf) - 1e-12:
                        seen[state] = y
                        nxt.append((*state, y))
            front = nxt
        best[start] = least
    return best


def random_case(seed):
    rng = random.Random(seed)
    nodes, kinds = range(9), range(3)
    pick = lambda n, f: [f() for _ in range(n)]
    fee = lambda: round(rng.uniform(0.5, 20), 3)
    rows = {
        "conversions": [(n, a, b, fee(), rng.choice([0.7, 0.8, 0.95])) for n in rng.sample(nodes, 5) for a, b in itertools.permutations(kinds, 2) if rng.random() < 0.5],
        "segments": [x for k in range(8) for c in kinds if rng.random() < 0.6 for f in [fee()] for x in ((k, k + 1, c, f"G{k // 3}", f, 0.01 * c), (k + 1, k, c, f"G{k // 3}", f, 0.01 * c))],
        "transfers": pick(3, lambda: tuple(rng.sample(nodes, 2))), "connectors": pick(8, lambda: (*rng.sample(nodes, 2), rng.choice(kinds), 2 * fee())),
        "ships": pick(6, lambda: (*rng.sample(nodes, 2), rng.choice(kinds), fee(), rng.choice([0.0, 0.05]))),
    }
    seeds = [(s, rng.choice(nodes), rng.choice(kinds), rng.uniform(1, 60)) for s in range(12)] + [(99, 50, 0, 5.0)]
    goals = [(n, c, rng.choice([0.0, 4.0, 9.0])) for n in rng.sample(nodes, 2) for c in rng.sample(kinds, 2)]
    return rows, seeds, goals


def follows(route, rows, seeds, goals):
    """The route's legs are steps of the network, keep the rules and add up to its cost."""
    moves, at = set(flat(rows)), next(s for s in seeds if s[0] == route["start_id"])
    n, c, x, free, shipped, visited, riding = at[1], at[2], at[3], True, False, set(), None
    for i, g in enumerate(route["legs"], 1):
        assert g["n"] == i and (n, c) == (g["src"], g["commodity"]) and g["paid"] == pytest.approx(x)
        assert any(m[:6] == (g["src"], g["commodity"], g["dst"], g["to"], g["kind"], g["network"]) and m[6:] == pytest.approx((g["fee"], g["share"])) for m in moves)
        assert not (g["kind"] == "connector" and not free) and not (g["kind"] == "ship" and shipped) and not (g["kind"] == "network" and g["network"] != riding and g["network"] in visited)
        free, shipped = False if g["kind"] == "connector" else g["kind"] in ("network", "ship") or free, shipped or g["kind"] == "ship"
        visited |= {g["network"]} - {None}
        riding = g["network"] if g["kind"] == "network" else riding if g["kind"] == "conversion" else None
        n, c, x = g["dst"], g["to"], (x + g["fee"]) / g["share"]
        assert g["cost"] == pytest.approx(x)
    assert (n, c) == (route["node"], route["commodity"]) and route["cost"] == pytest.approx(x)
    assert route["net"] == pytest.approx(x - next(p for a, b, p in goals if (a, b) == (n, c)))


@pytest.mark.parametrize("seed", [2])
def test_search_equals_itself_without_bounds_and_keeps_the_rules(spark, seed):
    rows, seeds, goals = random_case(seed)
    found, got = run(spark, rows, seeds, goals)
    free, plain = run(spark, rows, seeds, goals, prune=False)
    net = {r["start_id"]: r["net"] for r in got}
    assert net == pytest.approx({r["start_id"]: r["net"] for r in plain})
    assert sum(f.count() for f in found.fronts) < sum(f.count() for f in free.fronts)
    exact = walk(rows, seeds, goals)
    assert all(net[s] >= exact[s] - 1e-9 for s in net) and all(s in net or exact[s] == math.inf for s in exact)
    for r in got:
        follows(r, rows, seeds, goals)


@pytest.mark.parametrize("seed", [4])
def test_tails_bound_from_both_sides(spark, seed):
    """From each seed: the least tail is at most the exact optimum, the cheapest that keeps all rules at least that."""
    rows, seeds, goals = random_case(seed)
    keep = Written(spark)
    g = spark.createDataFrame(goals, "node long, commodity long, price double")
    tails = supply.tails(keep.cut(steps(spark, **rows)), g, 1.0, keep)
    first = spark.createDataFrame([(s, n, c, True, x, 0, False, [], None) for s, n, c, x in seeds], "start_id long, node long, commodity long, free boolean, cost double, hops int, shipped boolean, visited array<string>, riding string")
    seen = {r.start_id: (r.least, r.can) for r in supply.with_route(supply.with_least(first, supply.by_node(tails, g)), True).collect()}
    exact = walk(rows, seeds, goals)
    assert set(seen) == {s for s, x in exact.items() if x < math.inf}
    for s, (least, can) in seen.items():
        assert least <= exact[s] + 1e-9 and (can is None or can >= exact[s] - 1e-9)
    assert any(can is not None for _, can in seen.values())


#: F-MIN, all rules on: fees in EUR/MWh of the known route's steps, and dear or useless alternatives.
NINE = {
    "connectors": [("start", "PG_0", "H2", 0.00311), ("PG_1", "s_0", "H2", 0.12662), ("s_1", "PL_0", "FTF", 0.00024), ("start", "PL_0", "H2", 1e6), ("PG_2", "s_2", "H2", 3000.0), ("s_3", "PL_0", "FTF", 3800.0)],
    "segments": [("PG_0", "PG_1", "H2", "PG", 0.00488, 0.0), ("PG_0", "PG_2", "H2", "PG", 195.2, 0.0), ("PL_1", "PL_0", "FTF", "PL", 0.00488, 0.0)],
    "ships": [("s_0", "s_1", "FTF", 0.0, 3e-7), ("s_0", "s_3", "FTF", 0.0, 9e-4), ("s_2", "s_1", "FTF", 0.0, 6e-4)],
    "conversions": [("s_0", "H2", "FTF", 81.320844, 0.8323), ("s_2", "H2", "FTF", 81.320844, 0.8323)],
}


@pytest.mark.parametrize("prune", [True, False])
def test_nine_nodes_with_every_rule(spark, prune):
    keep = Written(spark)
    seeds = spark.createDataFrame([(1, "start", "H2", 0.0)], "start_id long, node string, commodity string, cost double")
    goals = supply.final_goals(spark.createDataFrame([("PL_0",)], "node string"), spark.createDataFrame([("FTF", None)], "commodity string, price double"))
    found = supply.search(seeds, keep.cut(steps(spark, "string", "string", **NINE)), goals, prune, keep)
    r = supply.routes(found, supply.cheapest(found), keep).first()
    assert r.cost <= 97.868170 + 1e-4 and r.cost == pytest.approx(97.86817, abs=1e-3)
    assert [(x.kind, x.dst) for x in r.legs] == [("connector", "PG_0"), ("network", "PG_1"), ("connector", "s_0"), ("conversion", "s_0"), ("ship", "s_1"), ("connector", "PL_0")]


def test_strike_prices_and_final_commodities_decide(spark):
    rows = {"connectors": [(0, 1, 0, 5.0)], "conversions": [(1, 0, 1, 10.0, 1.0), (1, 0, 2, 1.0, 1.0)]}
    seeds = [(7, 0, 0, 20.0)]
    assert [(r["commodity"], r["cost"], r["net"]) for r in run(spark, rows, seeds, [(1, 1, 0.0), (1, 2, 0.0)])[1]] == [(2, 26.0, 26.0)]
    found, best = run(spark, rows, seeds, [(1, 1, 30.0), (1, 2, 2.0), (1, 2, 1.0)])
    assert [(r["commodity"], r["cost"], r["net"]) for r in best] == [(1, 35.0, 5.0)]
    assert {(r.commodity, r.net) for r in run(spark, rows, seeds, [(1, 1, 30.0), (1, 2, 2.0)], prune=False)[0].arrivals.collect()} == {(1, 5.0), (2, 24.0)}


def test_a_route_that_the_search_cannot_keep_does_not_change_the_answer(spark):
    """The cheapest way to node 2 enters network A, which the way on needs; the bound by tails would lose the dearer one."""
    rows = {
        "segments": [(0, 1, 0, "A", 1.0, 0.0), (3, 4, 0, "A", 1.0, 0.0), (0, 5, 0, "B", 3.0, 0.0)], "transfers": [(1, 2), (5, 2), (2, 3)], "connectors": [(2, 4, 0, 50.0)],
    }
    seeds, goals = [(1, 0, 0, 10.0)], [(4, 0, 0.0)]
    got = [run(spark, rows, seeds, goals, p)[1] for p in (True, False)]
    assert [r["net"] for x in got for r in x] == [61.0, 61.0] and walk(rows, seeds, goals) == {1: 14.0}
    for r in got[0]:
        follows(r, rows, seeds, goals)


def test_starts_at_a_goal_without_a_way_or_a_cost(spark):
    rows = {"connectors": [(0, 1, 0, 5.0), (1, 0, 0, 5.0)], "transfers": [(0, 2), (2, 0)]}
    seeds = [(1, 1, 0, 3.0), (2, 0, 0, 3.0), (2, 0, 0, 2.0), (3, 8, 0, 1.0), (4, 0, 0, None), (5, 0, 0, math.inf), (6, 0, 0, math.nan)]
    got = sorted((r["start_id"], r["net"], len(r["legs"])) for r in run(spark, rows, seeds, [(1, 0, 0.0)])[1])
    assert got == [(1, 3.0, 0), (2, 7.0, 1)]
    assert run(spark, rows, [], [(1, 0, 0.0)])[1] == [] and run(spark, rows, seeds, [])[1] == [] and run(spark, {}, seeds, [(1, 0, 0.0)])[1][0]["net"] == 3.0


def test_results_of_routes(spark):
    rows = {"connectors": [(0, 1, 0, 5.0)], "conversions": [(1, 0, 1, 10.0, 0.5)], "ships": [(1, 2, 1, 2.0, 0.2)]}
    keep = Written(spark)
    s = spark.createDataFrame([(1, 0, 0, 20.0), (2, 1, 0, 20.0), (3, 2, 1, 4.0)], "start_id long, node long, commodity long, cost double")
    g = spark.createDataFrame([(2, 1, 0.0)], "node long, commodity long, price double")
    found = supply.search(s, keep.cut(steps(spark, **rows)), g, keep=keep)
    routes = keep.cut(supply.routes(found, supply.cheapest(found), keep))
    cost = {r.start_id: r for r in results.route_costs(routes).collect()}
    assert (cost[1].production, cost[1].conversion, cost[1].transport, cost[1].efficiency) == pytest.approx((20.0, 45.0, 25.0, 0.4))
    assert all(r.production + r.conversion + r.transport == pytest.approx(r.cost) for r in cost.values())
    assert (cost[3].means, cost[3].start_commodity, cost[1].means, cost[1].commodities) == ("", 1, "connector>conversion>ship", "1")
    flows = results.route_flows(supply.legs(routes), spark.createDataFrame([(1, 100.0), (2, 10.0), (3, 1.0)], "start_id long, quantity double"))
    assert {(r.kind, r.a, r.b, r.commodity): (r.flow, r.routes) for r in flows.collect()} == {("connector", 0, 1, 0): (100.0, 1), ("ship", 1, 2, 1): (55.0, 2)}


def test_goals_within_the_tolerance(spark):
    nodes = spark.createDataFrame([(1, 0.0, 179.9), (2, 0.0, -179.9), (3, 1.0, 0.0), (4, 89.9, 10.0)], "node long, lat double, lon double")
    ends = spark.createDataFrame([(1, 0.0, 180.0), (2, 89.9, -170.0)], "id long, lat double, lon double")
    assert sorted(r.node for r in supply.nodes_near(nodes, ends, 30_000.0).collect()) == [1, 2, 4]
    assert supply.nodes_near(nodes.filter(F.lit(False)), ends, 30_000.0).count() == 0


def test_commodity_dimension(spark):
    rows = [(0, 1, 5.0, 0.9), (0, 1, 4.0, 0.8), (0, 2, 7.0, 0.7), (1, 0, None, 0.5)]
    c = spark.createDataFrame(rows, "commodity long, to long, fee double, eff double")
    got = {r.commodity: tuple(r)[1:] for r in results.commodity_dimension(c, {"even": F.col("commodity") % 2 == 0}).collect()}
    assert got == {0: ([1, 2], 4.0, 0.7, True), 1: ([0], None, 0.5, False)}
    assert results.commodity_dimension(c.limit(0), {}).count() == 0
