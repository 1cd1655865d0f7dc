"""Spatial joins, graph operators and routing."""

from pyspark.sql import functions as F

from haulgraph.functions import cost as C
from haulgraph.operators import spatial as X
from haulgraph.operators import state as S
from haulgraph.plans import graphs as G
from haulgraph.plans import routing as R
from haulgraph.plans import supply as P
from haulgraph.sources import network_view as V

from .registry import haversine, lat, lon, query, views


def _points(df, key, side):
    return df.select(F.col(key).alias(f"{side}_id"), F.col("lat").alias(f"{side}_lat"), F.col("lon").alias(f"{side}_lon"))


@query(f"{views('starts', 'nodes')}, p AS (SELECT start_id, key AS node, {haversine('s.lat', 's.lon', 'n.lat', 'n.lon')} AS distance_m FROM starts s, nodes n) SELECT * FROM p WHERE distance_m <= 800000")
def theta_distance_join(spark, d):
    return X.within_distance(_points(V.starts(spark, d), "start_id", "l"), _points(V.nodes(spark, d), "key", "r"), 800_000.0).select(F.col("l_id").alias("start_id"), F.col("r_id").alias("node"), "distance_m")


@query(f"{views('starts', 'nodes')}, p AS (SELECT start_id, key AS node, {haversine('s.lat', 's.lon', 'n.lat', 'n.lon')} AS distance_m FROM starts s JOIN countries c USING (nationkey) JOIN nodes n ON n.continent = c.continent) SELECT * FROM p WHERE distance_m <= 3000000")
def blocked_theta_join(spark, d):
    """The same within reachable continents, which part the join first."""
    s = V.starts(spark, d).join(F.broadcast(V.countries(spark, d)), "nationkey").select(F.col("start_id").alias("l_id"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"), "continent")
    n = V.nodes(spark, d).select(F.col("key").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), "continent")
    return X.within_distance(s, n, 3_000_000.0, ("continent",)).select(F.col("l_id").alias("start_id"), F.col("r_id").alias("node"), "distance_m")


@query(f"""{views('nodes')}, p AS (SELECT a.key AS id, b.key AS near, {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS distance_m FROM nodes a JOIN nodes b ON a.key <> b.key AND coalesce(a.graph_id, 'SEA') <> coalesce(b.graph_id, 'SEA'))
SELECT id, arg_min(near, {{'d': distance_m, 'n': near}}) AS near, min(distance_m) AS distance_m FROM p GROUP BY id""")
def nearest_neighbour(spark, d):
    n = V.nodes(spark, d).select(F.col("key").alias("id"), "lat", "lon", F.coalesce("graph_id", F.lit("SEA")).alias("graph"))
    return X.nearest_other(n, "graph", 1_000_000.0)


@query(f"""{views('nodes')} SELECT a.key AS node, list_sort(list(b.key)) AS others FROM nodes a JOIN nodes b ON a.key <> b.key WHERE {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 1500000 GROUP BY a.key""")
def within_tolerance_list(spark, d):
    n = V.nodes(spark, d)
    near = X.within_distance(_points(n, "key", "l"), _points(n, "key", "r"), 1_500_000.0).filter("l_id <> r_id")
    return near.groupBy(F.col("l_id").alias("node")).agg(F.array_sort(F.collect_list("r_id")).alias("others"))


@query(f"""{views('starts')}, c AS (SELECT s_suppkey AS cell, floor({lat('s_suppkey')} * 4 + 0.5) / 4 AS cell_lat, floor({lon('s_suppkey')} * 4 + 0.5) / 4 AS cell_lon FROM supplier),
k AS (SELECT c.cell + 1000 * a AS cell, cell_lat + a / 4 AS cell_lat, cell_lon + b / 4 AS cell_lon FROM c, range(-8, 9) x(a), range(-8, 9) y(b) WHERE (a + b) % 3 = 0),
u AS (SELECT min(cell) AS cell, cell_lat, cell_lon FROM k GROUP BY cell_lat, cell_lon),
p AS (SELECT start_id AS id, cell, {haversine('lat', 'lon', 'cell_lat', 'cell_lon')} AS distance_m FROM starts JOIN u ON abs(cell_lat - floor(lat * 4 + 0.5) / 4) <= 0.5 AND abs(cell_lon - floor(lon * 4 + 0.5) / 4) <= 0.5)
SELECT id, arg_min(cell, {{'d': distance_m, 'c': cell}}) AS cell, min(distance_m) AS distance_m FROM p GROUP BY id""")
def nearest_cell_lookup(spark, d):
    from haulgraph.functions.geo import round_quarter

    n = V.nodes(spark, d)
    steps = F.sequence(F.lit(-8), F.lit(8))
    c = n.select(F.col("key").alias("cell"), round_quarter(F.col("lat")).alias("cell_lat"), round_quarter(F.col("lon")).alias("cell_lon")).withColumn("a", F.explode(steps)).withColumn("b", F.explode(steps)).filter("(a + b) % 3 = 0")
    cells = c.groupBy((F.col("cell_lat") + F.col("a") / 4).alias("cell_lat"), (F.col("cell_lon") + F.col("b") / 4).alias("cell_lon")).agg(F.min(F.col("cell") + 1000 * F.col("a")).alias("cell"))
    return X.nearest_cell(V.starts(spark, d).select(F.col("start_id").alias("id"), "lat", "lon"), cells)


@query(f"{views('edges', 'nodes')} SELECT node, min(root) AS root FROM (SELECT e.graph_id, unnest([src, dst]) AS node, min(src) OVER (PARTITION BY e.graph_id) AS root FROM edges e) GROUP BY node")
def components(spark, d):
    return G.components(V.edges(spark, d).select("src", "dst"))


_BOTH = "b AS (SELECT src, dst, distance_m FROM edges UNION ALL SELECT dst, src, distance_m FROM edges)"


@query(f"""{views('edges')}, p AS (SELECT graph_id, key, sum(coalesce(distance_m, 0)) OVER (PARTITION BY graph_id ORDER BY key) AS at FROM (SELECT n.graph_id, n.key, e.distance_m FROM nodes n LEFT JOIN edges e ON e.dst = n.key WHERE n.graph_id IS NOT NULL))
SELECT min(f.key) AS source, t.key AS node, min(abs(t.at - f.at)) AS cost FROM p t JOIN p f ON t.graph_id = f.graph_id AND f.key = (SELECT min(key) FROM p z WHERE z.graph_id = t.graph_id) WHERE t.graph_id IN (SELECT graph_id FROM edges) GROUP BY t.key""")
def sssp(spark, d):
    """From the first node of every network. The networks are chains, so the SQL sums along them."""
    e = V.edges(spark, d)
    both = S.both_ways(e.select("src", "dst", F.col("distance_m").alias("cost")), "src", "dst")
    first = e.groupBy("graph_id").agg(F.min("src").alias("source")).select("source", F.col("source").alias("node"))
    return G.shortest(both, first)


@query(f"""{views('edges')}, p AS (SELECT graph_id, key, sum(coalesce(distance_m, 0)) OVER (PARTITION BY graph_id ORDER BY key) AS at FROM (SELECT n.graph_id, n.key, e.distance_m FROM nodes n LEFT JOIN edges e ON e.dst = n.key WHERE n.graph_id IS NOT NULL))
SELECT a.key AS source, b.key AS node, abs(a.at - b.at) AS cost FROM p a JOIN p b USING (graph_id) WHERE graph_id IN (SELECT graph_id FROM edges)""")
def all_pairs(spark, d):
    e = V.edges(spark, d)
    both = S.both_ways(e.select("src", "dst", F.col("distance_m").alias("cost")), "src", "dst")
    every = both.select(F.col("src").alias("source")).distinct().select("source", F.col("source").alias("node"))
    return G.shortest(both, every)


@query("""WITH RECURSIVE c AS (SELECT DISTINCT a.n_regionkey AS x, b.n_regionkey AS y FROM nation a JOIN nation b ON a.n_nationkey + 2 = b.n_nationkey WHERE a.n_regionkey < b.n_regionkey),
t AS (SELECT x, y FROM c UNION SELECT t.x, c.y FROM t JOIN c ON t.y = c.x) SELECT x, y FROM t""")
def closure(spark, d):
    """Pairs of regions joined by chains of connections: doubling, so rounds are logarithmic."""
    n = V.read(spark, d, "nation")
    b = n.select((F.col("n_nationkey") - 2).alias("n_nationkey"), F.col("n_regionkey").alias("y"))
    pairs = G.cut(n.join(b, "n_nationkey").filter("n_regionkey < y").select(F.col("n_regionkey").alias("x"), "y").distinct())
    while True:
        more = G.cut(pairs.unionByName(pairs.select("x", F.col("y").alias("via")).join(pairs.select(F.col("x").alias("via"), "y"), "via").select("x", "y")).distinct())
        if more.count() == pairs.count():
            return pairs
        pairs = more


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey % 40 AS src, l_suppkey % 40 + l_linenumber AS dst FROM lineitem),
f AS (SELECT 1::BIGINT AS node UNION SELECT dst FROM f JOIN e ON node = src), b AS (SELECT 38::BIGINT AS node UNION SELECT src FROM b JOIN e ON node = dst)
SELECT src, dst FROM e WHERE src IN (SELECT node FROM f) AND dst IN (SELECT node FROM b)""")
def two_way_reachability(spark, d):
    src = F.col("l_suppkey") % 40
    e = G.cut(V.read(spark, d, "lineitem").select(src.alias("src"), (src + F.col("l_linenumber")).alias("dst")).distinct())
    one = lambda k: spark.range(k, k + 1).withColumnRenamed("id", "node")
    return G.on_some_path(e, one(1), one(38))


_STATE = f"""{views('edges', 'starts')}, {_BOTH}, s AS (SELECT src, dst, c AS commodity, distance_m / 1000 * 0.01::DOUBLE * (c + 1) AS fee, 0.01::DOUBLE * c AS loss, graph_id AS network FROM (SELECT src, dst, distance_m, graph_id FROM edges UNION ALL SELECT dst, src, distance_m, graph_id FROM edges), range(3) t(c)),
v AS (SELECT key AS node, a AS commodity, z AS to_c, (key * 31 + a * 7 + z * 3) % 50 + 1 AS fee, 0.6::DOUBLE + ((a * 5 + z * 11) % 40) / 100::DOUBLE AS efficiency FROM nodes, range(3) x(a), range(3) y(z) WHERE convertible AND a <> z),
far AS (SELECT a.key AS src, b.key AS dst, a.node_type = 'port' AND b.node_type = 'port' AS ports, coalesce(a.graph_id, 'SEA') <> coalesce(b.graph_id, 'SEA') AS other, {haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS distance_m FROM nodes a JOIN nodes b ON a.key <> b.key),
x AS (SELECT src, dst FROM far WHERE other AND distance_m <= 300000),
j AS (SELECT src, dst, c AS commodity, distance_m * 1.5::DOUBLE / 1000 * 0.05::DOUBLE * (c + 1) AS fee FROM far, range(3) t(c) WHERE other AND distance_m > 300000 AND distance_m <= 900000),
h AS (SELECT src, dst, c AS commodity, distance_m / 1000 * 0.004::DOUBLE * (c + 1) AS fee, distance_m / 1000 / 25 / 24 * 0.002::DOUBLE * (c + 1) AS loss FROM far, range(3) t(c) WHERE ports AND distance_m <= 6000000),
"""


def _routes(spark, d, limit=None):
    """The tables of a routing run: conversions, segments, transfers, connectors, ships; seeds; goals. None is worked out before it is read.

    With ``limit``, connectors and ships are met only as far as some commodity's fee stays under it.
    """
    reach = lambda most, rate: most if limit is None else min(most, limit / rate * 1000 * 1.000001 + 1)
    e = S.both_ways(V.edges(spark, d).select("src", "dst", "distance_m", "graph_id"), "src", "dst")
    kinds = F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))
    each = lambda df: df.withColumn("commodity", F.explode(kinds))
    km, kind = F.col("distance_m") / 1000, F.col("commodity") + 1
    segments = each(e).select(F.col("src").alias("node"), "dst", "commodity", F.col("graph_id").alias("network"), (km * 0.01 * kind).alias("fee"), (F.col("commodity") * 0.01).alias("loss"))
    n = V.nodes(spark, d)
    pairs = n.filter("convertible").select(F.col("key").alias("node")).withColumn("commodity", F.explode(kinds)).withColumn("to", F.explode(kinds)).filter("commodity <> to")
    conversions = pairs.select("node", "commodity", "to", ((F.col("node") * 31 + F.col("commodity") * 7 + F.col("to") * 3) % 50 + 1).cast("double").alias("fee"), (F.lit(0.6) + ((F.col("commodity") * 5 + F.col("to") * 11) % 40) / 100.0).alias("efficiency"))
    graph = n.select(F.col("key").alias("l_id"), F.coalesce("graph_id", F.lit("SEA")).alias("a")), n.select(F.col("key").alias("r_id"), F.coalesce("graph_id", F.lit("SEA")).alias("b"))
    near = X.within_distance(_points(n, "key", "l"), _points(n, "key", "r"), max(300_000.0, reach(900_000.0, 0.075))).join(graph[0], "l_id").join(graph[1], "r_id").filter("a <> b").select(F.col("l_id").alias("node"), F.col("r_id").alias("dst"), "distance_m")
    transfers = near.filter("distance_m <= 300000").select("node", "dst")
    connectors = each(near.filter("distance_m > 300000")).select("node", "dst", "commodity", (C.detour(F.col("distance_m"), 300_000.0) / 1000 * 0.05 * kind).alias("fee"))
    ports = n.filter("node_type = 'port'")
    lanes = X.within_distance(_points(ports, "key", "l"), _points(ports, "key", "r"), reach(6_000_000.0, 0.004)).filter("l_id <> r_id").select(F.col("l_id").alias("node"), F.col("r_id").alias("dst"), "distance_m")
    ships = each(lanes).select("node", "dst", "commodity", (km * 0.004 * kind).alias("fee"), (km / 25 / 24 * 0.002 * kind).alias("loss"))
    size = V.read(spark, d, "supplier").count()
    seeds = V.starts(spark, d).select("start_id", (F.col("start_id") % size).alias("node"), F.lit(0).cast("long").alias("commodity"), "cost")
    goals = n.filter(F.col("key") % 5 == 2).select(F.col("key").alias("node"))
    tables = {"conversions": conversions, "segments": segments, "transfers": transfers, "connectors": connectors, "ships": ships}
    return seeds, tables, goals


def _steps(spark, d, kinds):
    """The steps of a routing run by the highest fee of a connector or ship."""
    return lambda limit: P.up_to(P.moves(_routes(spark, d, limit)[1], kinds))(limit)


@query(f"""{_STATE} r(start_id, node, commodity, free, cost, hops, shipped, visited, riding) USING KEY (start_id, node, commodity, free) AS (
 SELECT start_id, start_id % (SELECT count(*) FROM supplier), 0::BIGINT, true, cost, 0, false, []::VARCHAR[], NULL::VARCHAR FROM starts
 UNION SELECT g.start_id, g.node, g.commodity, g.free, g.b.cost, g.b.hops, g.b.shipped, g.b.visited, g.b.riding FROM (
  SELECT start_id, node, commodity, free, min({{'cost': cost, 'hops': hops, 'shipped': shipped, 'visited': visited, 'riding': riding}}) AS b FROM (
   SELECT start_id, r.node, to_c AS commodity, free, (cost + fee) / efficiency AS cost, hops + 1 AS hops, shipped, visited, riding FROM r JOIN v ON r.node = v.node AND r.commodity = v.commodity
   UNION ALL SELECT start_id, dst, r.commodity, true, (cost + fee) / (1 - loss), hops + 1, shipped, list_sort(list_distinct(list_append(visited, network))), network FROM r JOIN s ON r.node = s.src AND r.commodity = s.commodity WHERE network IS NOT DISTINCT FROM riding OR NOT list_contains(visited, network)
   UNION ALL SELECT start_id, dst, commodity, free, cost, hops + 1, shipped, visited, NULL FROM r JOIN x ON r.node = x.src
   UNION ALL SELECT start_id, dst, r.commodity, false, cost + fee, hops + 1, shipped, visited, NULL FROM r JOIN j ON r.node = j.src AND r.commodity = j.commodity WHERE free
   UNION ALL SELECT start_id, dst, r.commodity, true, (cost + fee) / (1 - loss), hops + 1, true, visited, NULL FROM r JOIN h ON r.node = h.src AND r.commodity = h.commodity WHERE NOT shipped)
  GROUP BY start_id, node, commodity, free) g LEFT JOIN recurring.r k ON k.start_id = g.start_id AND k.node = g.node AND k.commodity = g.commodity AND k.free = g.free WHERE k.cost IS NULL OR g.b.cost < k.cost)
SELECT start_id, round(min(cost), 8) AS cost FROM r WHERE node % 5 = 2 GROUP BY start_id""")
def routing_fixpoint(spark, d):
    """Each start's cheapest arrival at a goal under all rules, with bounds, until no branch is left."""
    seeds, _, goals = _routes(spark, d)
    keep = G.Written(spark)
    kinds = spark.range(3).withColumnRenamed("id", "commodity")
    found = P.search(seeds, _steps(spark, d, kinds), P.final_goals(goals, kinds.withColumn("price", F.lit(0.0))), keep=keep)
    return P.cheapest(found).select("start_id", F.round("cost", 8).alias("cost"))


@query(f"""{_STATE} r(start_id, node, commodity, cost) USING KEY (start_id, node, commodity) AS (SELECT start_id, start_id % (SELECT count(*) FROM supplier) AS node, 0::BIGINT AS commodity, cost FROM starts
 UNION SELECT x.start_id, x.node, x.commodity, x.cost FROM (SELECT start_id, node, commodity, min(cost) AS cost FROM (
  SELECT start_id, dst AS node, r.commodity, (cost + fee) / (1 - loss) AS cost FROM r JOIN s ON r.node = s.src AND r.commodity = s.commodity
  UNION ALL SELECT start_id, r.node, to_c, (cost + fee) / efficiency FROM r JOIN v ON r.node = v.node AND r.commodity = v.commodity) GROUP BY ALL) x
  LEFT JOIN recurring.r k ON k.start_id = x.start_id AND k.node = x.node AND k.commodity = x.commodity WHERE k.cost IS NULL OR x.cost < k.cost)
SELECT start_id, node, commodity, round(cost, 8) AS cost FROM r""")
def export_enumeration(spark, d):
    """Every state a start reaches by conversions and segments, at its least cost, until no branch is left."""
    seeds, tables, _ = _routes(spark, d)
    best = R.reached(seeds, G.cut(tables["conversions"]), G.cut(tables["segments"].withColumnRenamed("node", "src")))
    return best.select("start_id", "node", "commodity", F.round("cost", 8).alias("cost"))
