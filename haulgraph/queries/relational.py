"""Filters, joins, set operations and reshaping."""

from pyspark.sql import functions as F

from haulgraph.functions import cost as C
from haulgraph.operators import prefix as P
from haulgraph.operators import spatial as X
from haulgraph.operators import state as S
from haulgraph.sources import network_view as V

from .registry import query, views


@query(f"{views('nodes')} SELECT key, node_type, lat, lon FROM nodes WHERE lat BETWEEN -35 AND 35 AND lon BETWEEN -21 AND 145")
def filter_bbox(spark, d):
    from haulgraph.functions.geo import in_box

    return V.nodes(spark, d).filter(in_box(F.col("lat"), F.col("lon"), -35, 35, -21, 145)).select("key", "node_type", "lat", "lon")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def filter_isin_anti(spark, d):
    o, c = V.read(spark, d, "orders"), V.read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    return o.filter(F.col("o_orderstatus").isin("F", "O")).join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.col("o_orderkey").alias("id"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'Infinity'::DOUBLE ELSE coalesce(value, 'Infinity'::DOUBLE) END AS cost FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, value FROM events WHERE event_id % 5 <> 0 AND event_id % 3 = 1 AND value IS NOT NULL")
def filter_finite(spark, d):
    """Every fifth event's value counts as not a number; what a value itself holds, NaN and infinity too, stays."""
    e = V.read(spark, d, "events")
    marked = F.col("event_id") % 5 == 0
    nan, own = F.lit(float("nan")), F.col("value")
    every = e.filter("event_id % 3 = 0").select("event_id", F.when(marked, C.finite_or_inf(nan)).otherwise(F.coalesce(own, F.lit(C.INF))).alias("cost"))
    return every.unionByName(e.filter("event_id % 3 = 1").filter(F.when(marked, C.is_finite(nan)).otherwise(own.isNotNull())).select("event_id", own.alias("cost")))


@query(f"{views('branches')}, bounds AS (SELECT commodity, ceil(avg(cost)) AS bound FROM branches GROUP BY commodity) SELECT branch_id, commodity, cost FROM branches JOIN bounds USING (commodity) WHERE cost <= bound")
def upper_bound_filter(spark, d):
    b = V.branches(spark, d)
    bounds = b.groupBy("commodity").agg(F.ceil(F.avg("cost")).alias("bound"))
    return S.within_bound(b, bounds, "commodity", "cost").select("branch_id", "commodity", "cost")


@query(f"""{views('branches', 'options')} SELECT branch_id, n FROM branches JOIN options ON branch_id = parent WHERE distance_m <= least((200000 - cost) * 1000 / nullif(rate * 100, 0) / 1.5, 30000)""")
def budget_distance_filter(spark, d):
    b, o = V.branches(spark, d), V.options(spark, d)
    budget = F.least(F.try_divide((200000 - F.col("cost")) * 1000, F.col("rate") * 100) / 1.5, F.when(F.col("rate") == 0, F.lit(None)).otherwise(F.lit(30000.0)))
    far = F.when(F.col("rate") == 0, F.lit(30000.0)).otherwise(budget)
    return b.join(o, F.col("branch_id") == F.col("parent")).filter(F.col("distance_m") <= far).select("branch_id", "n")


_REASON = "CASE WHEN loss >= 0.08 THEN 'loss' WHEN distance_m > 45000 THEN 'length' WHEN mean = 'R' AND rate > 0.05 THEN 'means' END"


@query(f"{views('options')} SELECT mean, {_REASON} AS reason, count(*) AS n FROM options GROUP BY ALL")
def reason_counts(spark, d):
    reason = F.when(F.col("loss") >= 0.08, "loss").when(F.col("distance_m") > 45000, "length").when((F.col("mean") == "R") & (F.col("rate") > 0.05), "means")
    return V.options(spark, d).groupBy("mean", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{views('branches', 'options')} SELECT parent, CASE WHEN min(CASE WHEN mean = 'A' THEN rate END) * 1e6 < any_value(cost) AND min(CASE WHEN mean = 'N' THEN rate END) * 1e6 < any_value(cost) THEN 'both'
 WHEN min(CASE WHEN mean = 'A' THEN rate END) * 1e6 < any_value(cost) THEN 'gas' WHEN min(CASE WHEN mean = 'N' THEN rate END) * 1e6 < any_value(cost) THEN 'liquid' ELSE 'none' END AS mode
 FROM options JOIN branches ON parent = branch_id GROUP BY parent""")
def mode_assignment(spark, d):
    o, b = V.options(spark, d), V.branches(spark, d).select("branch_id", "cost")
    x = o.groupBy("parent").agg(F.min(F.when(F.col("mean") == "A", F.col("rate"))).alias("gas"), F.min(F.when(F.col("mean") == "N", F.col("rate"))).alias("liquid")).join(b, F.col("parent") == F.col("branch_id"))
    gas, liquid = F.coalesce(F.col("gas") * 1e6 < F.col("cost"), F.lit(False)), F.coalesce(F.col("liquid") * 1e6 < F.col("cost"), F.lit(False))
    return x.select("parent", F.when(gas & liquid, "both").when(gas, "gas").when(liquid, "liquid").otherwise("none").alias("mode"))


@query(f"""{views('steps')}, x AS (SELECT route, n, flag, node, lag(flag) OVER w AS last_flag, lag(node) OVER w AS last_node FROM steps WINDOW w AS (PARTITION BY route ORDER BY n))
SELECT route, n FROM x WHERE last_node IS NOT NULL AND NOT (flag = 'A' AND last_flag = 'A') AND node <> last_node""")
def connector_state(spark, d):
    """No two connectors in a row, no node twice in a row."""
    from pyspark.sql import Window

    w = Window.partitionBy("route").orderBy("n")
    o = V.steps(spark, d).withColumn("last_flag", F.lag("flag").over(w)).withColumn("last_node", F.lag("node").over(w))
    return o.filter(F.col("last_node").isNotNull() & ~((F.col("flag") == "A") & (F.col("last_flag") == "A")) & (F.col("node") != F.col("last_node"))).select("route", "n")


@query(f"{views('options')}, h AS (SELECT parent, list(DISTINCT node % 10) AS seen FROM options WHERE mean = 'A' GROUP BY parent) SELECT o.parent, o.n FROM options o LEFT JOIN h USING (parent) WHERE o.mean <> 'A' AND NOT coalesce(list_contains(seen, o.node % 10), false)")
def visited_filter(spark, d):
    o = V.options(spark, d)
    h = o.filter("mean = 'A'").groupBy("parent").agg(F.collect_set(F.col("node") % 10).alias("seen"))
    return o.filter("mean <> 'A'").join(h, "parent", "left").filter(~F.coalesce(F.array_contains("seen", F.col("node") % 10), F.lit(False))).select("parent", "n")


@query("SELECT least(l_suppkey, l_partkey % 100) AS a, greatest(l_suppkey, l_partkey % 100) AS b, min(l_quantity) AS distance FROM lineitem WHERE l_suppkey <> l_partkey % 100 GROUP BY ALL")
def edge_dedupe_undirected(spark, d):
    li = V.read(spark, d, "lineitem").filter("l_suppkey <> l_partkey % 100")
    a, b = S.undirected(F.col("l_suppkey"), F.col("l_partkey") % 100)
    return li.groupBy(a.alias("a"), b.alias("b")).agg(F.min("l_quantity").alias("distance"))


@query(f"{views('edges')}, g AS (SELECT node, count(*) AS c FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node) SELECT graph_id, src, dst FROM edges WHERE NOT (distance_m < 5000000 AND (src IN (SELECT node FROM g WHERE c = 1) OR dst IN (SELECT node FROM g WHERE c = 1)))")
def dead_end_edges(spark, d):
    e = V.edges(spark, d)
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").count().filter("count = 1").select("node")
    short = e.filter("distance_m < 5000000")
    hit = short.join(ends, F.col("src") == F.col("node"), "left_semi").unionByName(short.join(ends, F.col("dst") == F.col("node"), "left_semi")).select("src", "dst").distinct()
    return e.join(hit, ["src", "dst"], "left_anti").select("graph_id", "src", "dst")


@query(f"{views('branches')}, best AS (SELECT node, commodity, min(cost) AS best FROM branches WHERE status = 'F' GROUP BY ALL) SELECT branch_id FROM branches LEFT JOIN best USING (node, commodity) WHERE status <> 'F' AND (best IS NULL OR cost <= best)")
def join_local_best(spark, d):
    b = V.branches(spark, d)
    best = b.filter("status = 'F'").groupBy("node", "commodity").agg(F.min("cost").alias("cost"))
    return S.not_dominated(b.filter("status <> 'F'"), best, ["node", "commodity"], "cost").select("branch_id")


@query(f"{views('branches', 'options')} SELECT parent, n, cost, list_sort(list(node) OVER (PARTITION BY parent))[1] AS first_node FROM options LEFT JOIN (SELECT branch_id, cost FROM branches WHERE status = 'F') ON parent = branch_id")
def join_history(spark, d):
    o, b = V.options(spark, d), V.branches(spark, d).filter("status = 'F'").select("branch_id", "cost")
    h = o.groupBy("parent").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    return o.join(h, "parent").join(b, F.col("parent") == F.col("branch_id"), "left").select("parent", "n", "cost", F.get("nodes", F.lit(0)).alias("first_node"))


@query(f"{views('nodes', 'options')} SELECT parent, n, country, continent FROM options JOIN nodes ON node = key")
def join_dimension_map(spark, d):
    o, n = V.options(spark, d), V.nodes(spark, d).select("key", "country", "continent")
    return o.join(n, F.col("node") == F.col("key")).select("parent", "n", "country", "continent")


@query(f"{views('branches', 'edges')} SELECT branch_id, dst AS reached, round(cost + distance_m / 1000 * 0.002, 6) AS cost FROM branches JOIN (SELECT src, dst, distance_m FROM edges UNION ALL SELECT dst, src, distance_m FROM edges) ON node = src")
def network_distance_join(spark, d):
    e = S.both_ways(V.edges(spark, d).select("src", "dst", "distance_m"), "src", "dst")
    b = V.branches(spark, d)
    return b.join(e, F.col("node") == F.col("src")).select("branch_id", F.col("dst").alias("reached"), F.round(F.col("cost") + C.line_haul(F.col("distance_m"), F.lit(0.002)), 6).alias("cost"))


@query("""WITH m AS (SELECT DISTINCT p_type AS c FROM part), r AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i FROM m)
SELECT s_suppkey AS node, a.c AS c_from, b.c AS c_to, (s_suppkey * 31 + a.i * 7 + b.i * 3) % 50 + 1 AS cost, round(0.6::DOUBLE + ((a.i * 5 + b.i * 11) % 40) / 100::DOUBLE, 2) AS efficiency
FROM supplier, r a, r b WHERE a.i <> b.i AND s_suppkey % 7 <> 0""")
def conversion_expand(spark, d):
    """Every node that converts, with every ordered pair of commodities."""
    from pyspark.sql import Window

    c = V.read(spark, d, "part").select(F.col("p_type").alias("c")).distinct().withColumn("i", F.row_number().over(Window.orderBy("c")) - 1)
    pairs = c.select(F.col("c").alias("c_from"), F.col("i").alias("i")).join(F.broadcast(c.select(F.col("c").alias("c_to"), F.col("i").alias("j"))), F.col("i") != F.col("j"))
    n = V.read(spark, d, "supplier").filter("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("node"))
    # commodities are a dimension of a few dozen rows; nodes are multiplied by their pairs, which is the result's size
    listed = pairs.agg(F.collect_list(F.struct("c_from", "c_to", "i", "j")))
    return n.withColumn("p", listed.scalar()).select("node", F.explode("p").alias("x")).select("node", "x.c_from", "x.c_to", ((F.col("node") * 31 + F.col("x.i") * 7 + F.col("x.j") * 3) % 50 + 1).alias("cost"), F.round(F.lit(0.6) + ((F.col("x.i") * 5 + F.col("x.j") * 11) % 40) / 100.0, 2).alias("efficiency"))


@query(f"{views('nodes', 'starts')} SELECT start_id, key AS node FROM starts JOIN countries USING (nationkey) JOIN nodes USING (continent) WHERE node_type = 'port'")
def same_region_semijoin(spark, d):
    """Starts with every port of their continent. There are five continents, so starts are dealt by their own key and meet ports in parts."""
    s = V.starts(spark, d).join(F.broadcast(V.countries(spark, d)), "nationkey").select("start_id", "continent")
    n = V.nodes(spark, d).filter("node_type = 'port'").select(F.col("key").alias("node"), "continent")
    return X.within_groups(s, n, "continent", "start_id", "node").select("start_id", "node")


@query("SELECT coalesce(a.k, b.k) AS k, a.x, b.y FROM (SELECT c_nationkey AS k, round(avg(c_acctbal), 6) AS x FROM customer WHERE c_nationkey < 18 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, round(avg(s_acctbal), 6) AS y FROM supplier WHERE s_nationkey > 5 GROUP BY 1) b ON a.k = b.k")
def outer_compare(spark, d):
    a = V.read(spark, d, "customer").filter("c_nationkey < 18").groupBy(F.col("c_nationkey").alias("k")).agg(F.round(F.avg("c_acctbal"), 6).alias("x"))
    b = V.read(spark, d, "supplier").filter("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("k")).agg(F.round(F.avg("s_acctbal"), 6).alias("y"))
    return a.join(b, "k", "outer")


@query(f"{views('nodes')} SELECT a.key AS a, b.key AS b FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id AND a.key < b.key")
def pair_self_join(spark, d):
    n = V.nodes(spark, d).filter("graph_id is not null").select("graph_id", "key")
    return n.select("graph_id", F.col("key").alias("a")).join(n.select("graph_id", F.col("key").alias("b")), "graph_id").filter("a < b").select("a", "b")


@query(f"""{views('starts', 'nodes')}, leg AS (SELECT start_id, s.lat, key, s.cost + abs(s.lat - n.lat) AS c FROM starts s JOIN countries c USING (nationkey) JOIN nodes n ON n.continent = c.continent WHERE node_type = 'port')
SELECT start_id, round(min(c + abs(leg.lat - p.lat) * 0.1 + p.key % 11), 6) AS cost FROM leg JOIN (SELECT key, lat FROM nodes WHERE node_type = 'port' AND continent = 'EUROPE') p ON p.key <> leg.key GROUP BY start_id""")
def three_leg_argmin(spark, d):
    """Start to port, port to port, port to destination: each start's cheapest chain."""
    s = V.starts(spark, d).join(F.broadcast(V.countries(spark, d)), "nationkey").select("start_id", "lat", "cost", "continent")
    p = V.nodes(spark, d).filter("node_type = 'port'").select("key", "lat", "continent")
    # the two best ports and goals of a start's place hold the best pair of different ones
    near = P.two_least(s, p.select("continent", "lat", F.lit(0.0).alias("value"), F.col("key").alias("name")), ["continent"], "lat", 1.0)
    goals = p.filter("continent = 'EUROPE'").select("lat", (F.col("key") % 11).alias("value"), F.col("key").alias("name"))
    far = P.two_least(s, goals, [], "lat", 0.1).withColumnRenamed("best", "ends")
    pairs = F.flatten(F.transform("best", lambda a: F.transform(F.filter("ends", lambda b: a["name"] != b["name"]), lambda b: a["cost"] + b["cost"])))
    chain = near.join(far, "lat").select("continent", "lat", F.array_min(pairs).alias("chain")).filter("chain is not null")
    return s.join(chain, ["continent", "lat"]).groupBy("start_id").agg(F.round(F.min(F.col("cost") + F.col("chain")), 6).alias("cost"))


@query(f"{views('edges')}, t(commodity, mean, rate) AS (VALUES ('H2', 'PG', 0.002::DOUBLE), ('CH4', 'PG', 0.001::DOUBLE), ('NH3', 'PL', 0.003::DOUBLE)) SELECT src, dst, commodity, round(distance_m / 1000 * rate, 6) AS cost FROM edges JOIN t ON mean = split_part(graph_id, '_', 1)")
def commodity_edge_expand(spark, d):
    t = spark.createDataFrame([("H2", "PG", 0.002), ("CH4", "PG", 0.001), ("NH3", "PL", 0.003)], "commodity string, mean string, rate double")
    e = V.edges(spark, d).withColumn("mean", F.split_part("graph_id", F.lit("_"), F.lit(1)))
    return e.join(F.broadcast(t), "mean").select("src", "dst", "commodity", F.round(C.line_haul(F.col("distance_m"), F.col("rate")), 6).alias("cost"))


@query("SELECT o_orderkey AS id, coalesce(a.c_acctbal, b.c_acctbal) AS balance FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) a ON o_custkey = a.c_custkey LEFT JOIN customer b ON o_custkey // 2 = b.c_custkey")
def fallback_coalesce_join(spark, d):
    o, c = V.read(spark, d, "orders"), V.read(spark, d, "customer").select("c_custkey", "c_acctbal")
    a = c.filter("c_custkey % 2 = 0").toDF("k1", "x1")
    b = c.toDF("k2", "x2")
    return o.join(a, F.col("o_custkey") == F.col("k1"), "left").join(b, F.floor(F.col("o_custkey") / 2) == F.col("k2"), "left").select(F.col("o_orderkey").alias("id"), F.coalesce("x1", "x2").alias("balance"))


@query("SELECT s_suppkey AS id, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def union_by_name(spark, d):
    s = V.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = V.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    return s.unionByName(c, allowMissingColumns=True)


@query("SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_tax > 0.07")
def key_intersect(spark, d):
    li = V.read(spark, d, "lineitem")
    return li.filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).intersect(li.filter("l_tax > 0.07").select("l_suppkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def key_difference(spark, d):
    return V.read(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(V.read(spark, d, "orders").filter("o_totalprice > 100000").select("o_custkey"))


@query(f"{views('edges')} SELECT src, dst, distance_m FROM edges UNION ALL SELECT dst, src, distance_m FROM edges")
def bidirectional_union(spark, d):
    return S.both_ways(V.edges(spark, d).select("src", "dst", "distance_m"), "src", "dst")


@query("SELECT k, upper(name) AS name, ceil(value) AS value FROM (SELECT l_orderkey * 10 + l_linenumber AS k, unnest(['quantity', 'price', 'tax']) AS name, unnest([l_quantity, l_extendedprice, l_tax * 100]) AS value FROM lineitem) WHERE value IS NOT NULL")
def matrix_unpivot(spark, d):
    li = V.read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_quantity").alias("QUANTITY"), F.col("l_extendedprice").alias("PRICE"), (F.col("l_tax") * 100).alias("TAX"))
    return li.unpivot("k", ["QUANTITY", "PRICE", "TAX"], "name", "value").filter("value is not null").select("k", "name", F.ceil("value").cast("double").alias("value"))


@query("SELECT l_suppkey AS k, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 4) AS a, round(sum(l_quantity) FILTER (l_returnflag = 'N'), 4) AS n, round(sum(l_quantity) FILTER (l_returnflag = 'R'), 4) AS r FROM lineitem GROUP BY 1")
def pairs_pivot(spark, d):
    li = V.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.sum("l_quantity"), 4))
    return li.toDF("k", "a", "n", "r")


@query(f"{views('steps')} SELECT route AS k, n - 1 AS step, node FROM steps")
def route_explode(spark, d):
    r = V.steps(spark, d).groupBy(F.col("route").alias("k")).agg(F.array_sort(F.collect_list(F.struct("n", "node"))).alias("route"))
    return r.select("k", F.posexplode("route").alias("step", "x")).select("k", "step", F.col("x.node").alias("node"))


@query("SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def resume_antijoin(spark, d):
    return V.read(spark, d, "orders").join(V.read(spark, d, "lineitem").filter("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.col("o_orderkey").alias("id"))
