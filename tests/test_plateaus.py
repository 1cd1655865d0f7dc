"""Searches where many branches cost the same, and steps whose rounds or tasks must not follow the size of a network."""

from pyspark.sql import functions as F

from haulgraph.plans import supply
from haulgraph.plans.graphs import Written
from tests.test_supply import run, steps


def test_free_steps_do_not_lead_the_search_over_all_that_costs_the_same(spark):
    ways = [(a, b) for i in range(30) for a, b in ((i, i + 1), (i + 1, i))]
    rows = {"transfers": ways, "conversions": [(12, 0, 1, 1.0, 0.5), (15, 0, 1, 1.0, 0.5), (25, 0, 1, 1.0, 0.5)]}
    found, got = run(spark, rows, [(1, 14, 0, 10.0), (2, 13, 0, 10.0)], [(17, 1, 0.0)])
    assert {r["start_id"]: (r["cost"], [(x["kind"], x["dst"]) for x in r["legs"]]) for r in got} == {
        s: (22.0, [("transfer", n) for n in range(at + 1, 16)] + [("conversion", 15), ("transfer", 16), ("transfer", 17)]) for s, at in ((1, 14), (2, 13))
    }
    assert len(found.fronts) == 6 and sum(f.count() for f in found.fronts) <= 14  # all 31 nodes and commodities before


def test_tails_stand_against_those_that_need_fewer_rules(spark):
    keep = Written(spark)
    rows = {"transfers": [(1, 2)], "ships": [(1, 2, 0, 5.0, 0.1)], "connectors": [(1, 2, 0, 3.0)]}
    goals = spark.createDataFrame([(2, 0, 0.0)], "node long, commodity long, price double")
    found = supply.tails(keep.cut(steps(spark, **rows)), goals, 1.0, keep).filter(F.col("node") == 1).collect()
    assert [(r.slope, r.base, r.steps, r.needs_free, r.has_ship) for r in found] == [(1.0, 0.0, 1, False, False)]  # three before


def test_groups_meet_in_parts_without_one_side_sent_whole(spark):
    from haulgraph.operators import spatial as X

    left = spark.range(500).select(F.col("id").alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("g"))
    right = spark.range(90).select(F.col("id").alias("b"), (F.col("id") % 3).alias("g"))
    got = X.within_groups(left, right, "g", "a", "b", block=8)
    every = left.join(right, "g").select("a", "b")
    assert got.select("a", "b").exceptAll(every).isEmpty() and every.exceptAll(got.select("a", "b")).isEmpty()
    keys = got.groupBy(F.spark_partition_id()).count().count()
    assert keys > 2  # a task a group before


def test_a_value_that_is_not_a_number_stays_as_in_the_sql(spark, tmp_path):
    import duckdb

    from haulgraph.queries import QUERIES, SQL

    values = [1.5, float("nan"), float("inf"), float("-inf"), None]
    events = spark.createDataFrame([(i, values[i // 15 % 5]) for i in range(90)], "event_id long, value double")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES["filter_finite"](spark, str(tmp_path)).collect()
    assert sorted((r.event_id, str(r.cost)) for r in got) == sorted((i, str(c)) for i, c in con.execute(SQL["filter_finite"]).fetchall())


def test_gaps_and_components_send_no_table_through_the_driver(spark, monkeypatch):
    from haulgraph.plans import graphs as G
    from haulgraph.plans import lines as L

    plans, plain, own = [], G.cut, Written.cut
    note = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(G, "cut", lambda df: note(df) or plain(df))
    monkeypatch.setattr(Written, "cut", lambda self, df: note(df) or own(self, df))
    ends = spark.createDataFrame([(i, i // 2, (i * 37 % 101) / 4.0, (i * 61 % 97) / 2.0) for i in range(60)], "id long, graph long, lat double, lon double")
    assert L.close_gaps(ends, 900_000.0, Written(spark)).count() == 29
    assert len(plans) > 10 and not [p for p in plans if "Broadcast" in p]


def test_states_reached_along_a_chain_in_few_rounds(spark, monkeypatch):
    from haulgraph.plans import graphs as G
    from haulgraph.plans import routing as R

    written, plain = [], G.cut
    ways = [(a, b, c, float((a * 7 + b * 3) % 5 + 1) * (c + 1), 0.02 * c) for i in [*range(24), *range(30, 33)] for a, b in ((i, i + 1), (i + 1, i)) for c in range(2)] + [(33, 30, 0, 1.0, 0.0), (30, 33, 0, 1.0, 0.0)]
    turns = [(n, c, 1 - c, float(n % 4 + 1), 0.7 + 0.1 * c) for n in (0, 5, 11, 19, 31, 50) for c in range(2)]
    seeds = [(1, 3, 0, 20.0), (2, 3, 0, 90.0), (3, 22, 0, 40.0), (4, 32, 0, 30.0), (5, 50, 0, 10.0)]
    expected = {(s, n, c): x for s, n, c, x in seeds}
    todo = list(expected)
    while todo:
        s, n, c = todo.pop()
        x = expected[s, n, c]
        for at, y in [((s, b, c), (x + f) / (1 - p)) for a, b, k, f, p in ways if (a, k) == (n, c)] + [((s, n, to), (x + f) / e) for a, k, to, f, e in turns if (a, k) == (n, c)]:
            if y < expected.get(at, 1e18) - 1e-12:
                expected[at] = y
                todo.append(at)
    count = lambda df: written.append(1) or plain(df)
    monkeypatch.setattr(G, "cut", count)
    monkeypatch.setattr(R, "cut", count)
    got = R.reached(
        spark.createDataFrame(seeds, "start_id int, node int, commodity int, cost double"), spark.createDataFrame(turns, "node int, commodity int, to int, fee double, efficiency double"),
        spark.createDataFrame(ways, "src int, dst int, commodity int, fee double, loss double"),
    )
    assert {(r.start_id, r.node, r.commodity): round(r.cost, 8) for r in got.collect()} == {k: round(x, 8) for k, x in expected.items()}
    assert len(written) < 120
