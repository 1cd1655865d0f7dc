"""What the fourth round's findings held against the queries, on small tables."""

from pyspark.sql import functions as F

from haulgraph.plans import routing as R


def test_states_reached_are_not_dealt_by_start(spark):
    """the rows of the result, many times the ways, went through a shuffle."""
    ways = spark.createDataFrame([(0, 0, 0, 0, 1.0, 0.0), (0, 0, 1, 0, 1.0, 5.0), (0, 0, 1, 0, 1.5, 1.0), (2, 0, 1, 0, 1.0, 9.0)], "src int, commodity int, dst int, to int, slope double, base double")
    seeds = [(1, 0, 0, 4.0), (2, 0, 0, 20.0), (3, 2, 0, 1.0)]
    s = lambda rows: spark.createDataFrame(rows, "start_id int, src int, commodity int, cost double")
    got = R._arrive(s(seeds), ways)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, 4.0), (1, 1, 0, 7.0), (2, 0, 0, 20.0), (2, 1, 0, 25.0), (3, 1, 0, 10.0)]
    assert "start_id" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)
    assert sorted(map(tuple, R._arrive(s([*seeds, (3, 0, 0, 2.0)]), ways).filter(F.col("start_id") == 3).collect())) == [(3, 0, 0, 2.0), (3, 1, 0, 4.0)]


def test_dear_ships_are_not_made(spark):
    """F2 to F6: every ship and connector was a written step, however dear beside the routes that do without."""
    from haulgraph.plans import supply as P
    from haulgraph.plans.graphs import Written

    limits = []
    schema = "node long, commodity long, dst long, to long, kind string, network string, fee double, share double"
    rows = [(0, 0, 1, 0, "transfer", None, 0.0, 1.0), (1, 0, 1, 1, "conversion", None, 2.0, 0.5), (0, 0, 0, 1, "conversion", None, 1.0, 0.5), (0, 0, 2, 0, "ship", None, 90.0, 1.0), (1, 1, 2, 1, "connector", None, 0.5, 1.0)]
    steps = lambda limit: limits.append(limit) or P.up_to(spark.createDataFrame(rows, schema))(limit)
    seeds = spark.createDataFrame([(1, 0, 0, 10.0), (2, 1, 0, 20.0)], "start_id long, node long, commodity long, cost double")
    goals = spark.createDataFrame([(1, 1, 0.0)], "node long, commodity long, price double")
    found = P.search(seeds, steps, goals, keep=Written(spark))
    assert {(r.start_id, r.net) for r in P.cheapest(found).collect()} == {(1, 24.0), (2, 44.0)}
    assert limits and max(limits) < 90.0
    assert P.upper_hull([(1.0, 5.0), (2.0, 4.0), (3.0, 9.0), (3.0, 1.0)]) == [(1.0, 5.0), (3.0, 9.0)]
