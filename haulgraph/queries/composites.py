"""Bounds, probes, model edges, area weights, access lists and telemetry reports."""

from pyspark.sql import functions as F

from haulgraph.operators import spatial as X
from haulgraph.operators import state as S
from haulgraph.plans import bounds as B
from haulgraph.plans.graphs import Written
from haulgraph.sources import network_view as V

from .registry import query, views

_KINDS = "k(c_from, c_to, fee, efficiency) AS (SELECT a, b, CASE WHEN a = b THEN 0::DOUBLE ELSE (a * 7 + b * 3) % 50 + 1::DOUBLE END, CASE WHEN a = b THEN 1::DOUBLE ELSE 0.6::DOUBLE + ((a * 5 + b * 11) % 40) / 100::DOUBLE END FROM range(5) x(a), range(5) y(b))"


def _kinds(spark):
    pair = spark.range(25).select(F.floor(F.col("id") / 5).alias("c_from"), (F.col("id") % 5).alias("c_to"))
    same = F.col("c_from") == F.col("c_to")
    fee = F.when(same, 0.0).otherwise((F.col("c_from") * 7 + F.col("c_to") * 3) % 50 + F.lit(1.0))
    return pair.select("c_from", "c_to", fee.alias("fee"), F.when(same, 1.0).otherwise(F.lit(0.6) + ((F.col("c_from") * 5 + F.col("c_to") * 11) % 40) / 100.0).alias("efficiency"))


@query(f"""WITH {_KINDS}, l AS (SELECT c_from AS via, arg_min(fee, {{'f': fee, 'e': efficiency}}) AS fee2, arg_min(efficiency, {{'f': fee, 'e': efficiency}}) AS eff2 FROM k GROUP BY 1)
SELECT o_orderkey AS branch_id, round(min(((o_totalprice + fee) / efficiency + (o_custkey % 900) * 1000 / 1e6 * (c_to + 1) + fee2) / eff2), 8) AS bound FROM orders JOIN k ON o_orderkey % 5 = c_from JOIN l ON via = c_to GROUP BY 1""")
def lower_bound_destination(spark, d):
    o = V.read(spark, d, "orders")
    b = o.select(F.col("o_orderkey").alias("branch_id"), (F.col("o_orderkey") % 5).alias("commodity"), F.col("o_totalprice").alias("cost"), (F.col("o_custkey") % 900 * 1000).alias("left_m"))
    rates = spark.range(5).select(F.col("id").alias("commodity"), (F.col("id") + 1).alias("rate"))
    return B.destination_bound(b, _kinds(spark), rates).select("branch_id", F.round("bound", 8).alias("bound"))


@query(f"""WITH RECURSIVE {_KINDS}, s AS (SELECT o_custkey % 2 AS commodity, min(o_totalprice) AS bound FROM orders GROUP BY 1),
r AS (SELECT commodity, bound, 0 AS n FROM s UNION ALL SELECT c_to, (bound + fee) / efficiency, n + 1 FROM r JOIN k ON commodity = c_from WHERE n < 4 AND c_from <> c_to) SELECT commodity, round(min(bound), 8) AS bound FROM r GROUP BY 1""")
def bound_propagation(spark, d):
    s = V.read(spark, d, "orders").groupBy((F.col("o_custkey") % 2).alias("commodity")).agg(F.min("o_totalprice").alias("bound"))
    return B.propagate(s, _kinds(spark)).select("commodity", F.round("bound", 8).alias("bound"))


@query(f"""{views('nodes', 'branches')}, e AS (SELECT branch_id, graph_id, node, cost FROM branches JOIN nodes ON node = key WHERE graph_id IS NOT NULL),
p AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY cost, branch_id) <= 5),
a AS (SELECT n.key AS node, min((p.cost + abs(n.key - p.node) * 100) * 1.00001::DOUBLE) AS arrival FROM p JOIN nodes n USING (graph_id) GROUP BY 1)
SELECT branch_id FROM e LEFT JOIN a USING (node) WHERE arrival IS NULL OR cost <= arrival""")
def probe_preselect(spark, d):
    n = V.nodes(spark, d).filter("graph_id is not null").select("graph_id", F.col("key").alias("node"))
    entries = V.branches(spark, d).join(n, "node").select("branch_id", "graph_id", "node", "cost")
    routes = n.select("graph_id", F.col("node").alias("src")).join(n.select("graph_id", F.col("node").alias("dst")), "graph_id").select("src", "dst", (F.abs(F.col("src") - F.col("dst")) * 100).alias("fee"))
    return B.probe_entries(entries, routes).select("branch_id")


@query(f"{views('steps')}, h AS (SELECT route, list(node) AS ancestors FROM steps GROUP BY 1) SELECT route AS branch_id FROM h WHERE NOT list_has_any(ancestors, [3, 17, 42])")
def superseded_descendants(spark, d):
    h = V.steps(spark, d).groupBy(F.col("route").alias("branch_id")).agg(F.collect_list("node").alias("ancestors"))
    return B.without_descendants(h, spark.createDataFrame([(3,), (17,), (42,)], "branch_id long")).select("branch_id")


_MODEL = f"""{views('nodes', 'edges')}, t(mean, commodity, rate) AS (VALUES ('PG', 0, 2::DOUBLE), ('PG', 1, 3::DOUBLE), ('PL', 2, 4::DOUBLE)), {_KINDS},
m AS (SELECT 'transport' AS kind, src || '+' || commodity AS src, dst || '+' || commodity AS dst, distance_m / 1e6 * rate AS fee, 0::DOUBLE AS loss FROM (SELECT src, dst, graph_id, distance_m FROM edges UNION ALL SELECT dst, src, graph_id, distance_m FROM edges) JOIN t ON mean = split_part(graph_id, '_', 1)
UNION ALL SELECT 'conversion', key || '+' || c_from, key || '+' || c_to, fee, 1 - efficiency FROM nodes, k WHERE convertible AND c_from <> c_to)"""


def _model(spark, d):
    e = S.both_ways(V.edges(spark, d).select("src", "dst", "distance_m", F.split_part("graph_id", F.lit("_"), F.lit(1)).alias("mean")), "src", "dst")
    t = spark.createDataFrame([("PG", 0, 2.0), ("PG", 1, 3.0), ("PL", 2, 4.0)], "mean string, commodity int, rate double")
    kinds = _kinds(spark).filter("c_from <> c_to").select(F.struct("*").alias("x")).agg(F.collect_list("x"))  # a dimension of 20 pairs
    n = V.nodes(spark, d).filter("convertible").select(F.col("key").alias("node"))
    c = n.withColumn("all", kinds.scalar()).select("node", F.explode("all").alias("x")).select("node", "x.*")
    return B.model_edges(e, t, c)


@query(f"{_MODEL} SELECT kind, src, dst, round(fee, 8) AS fee, round(loss, 8) AS loss FROM m")
def model_edge_table(spark, d):
    return _model(spark, d).select("kind", "src", "dst", F.round("fee", 8).alias("fee"), F.round("loss", 8).alias("loss"))


@query(f"{_MODEL} SELECT kind, count(*) AS n FROM m WHERE (fee + 10) / greatest(1 - loss, 1e-9) <= 45.03 GROUP BY kind")
def warm_start_pruning(spark, d):
    return B.affordable(_model(spark, d), 45.03, 10.0).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{views('nodes')}, b AS (SELECT key AS id, floor(lat * 4) / 4 - 0.4::DOUBLE AS south, floor(lat * 4) / 4 + 0.4::DOUBLE AS north, floor(lon * 4) / 4 - 0.3::DOUBLE AS west, floor(lon * 4) / 4 + 0.3::DOUBLE AS east FROM nodes),
c AS (SELECT DISTINCT round(lat * 4)::INT + x AS i, round(lon * 4)::INT + y AS j FROM nodes, range(-1, 2) t(x), range(-1, 2) u(y)),
m AS (SELECT id, greatest(least(north, (i + 0.5::DOUBLE) * 0.25::DOUBLE) - greatest(south, (i - 0.5::DOUBLE) * 0.25::DOUBLE), 0) * greatest(least(east, (j + 0.5::DOUBLE) * 0.25::DOUBLE) - greatest(west, (j - 0.5::DOUBLE) * 0.25::DOUBLE), 0) AS area, abs(i * 3 + j) % 7 AS q, abs(i + j * 5) % 11 AS cost FROM b JOIN c ON (i + 0.5::DOUBLE) * 0.25::DOUBLE > south AND (i - 0.5::DOUBLE) * 0.25::DOUBLE < north AND (j + 0.5::DOUBLE) * 0.25::DOUBLE > west AND (j - 0.5::DOUBLE) * 0.25::DOUBLE < east)
SELECT id, round(CASE WHEN sum(area * q) > 0 THEN sum(area * q * cost) / sum(area * q) WHEN sum(area) > 0 THEN sum(area * cost) / sum(area) ELSE 'Infinity'::DOUBLE END, 6) AS cost FROM b LEFT JOIN m USING (id) GROUP BY id""")
def area_weighted_cost(spark, d):
    n = V.nodes(spark, d)
    low = lambda c: F.floor(F.col(c) * 4) / 4.0
    boxes = n.select(F.col("key").alias("id"), (low("lat") - 0.4).alias("south"), (low("lat") + 0.4).alias("north"), (low("lon") - 0.3).alias("west"), (low("lon") + 0.3).alias("east"))
    off = F.sequence(F.lit(-1), F.lit(1))
    c = n.select(F.round(F.col("lat") * 4).cast("int").alias("i"), F.round(F.col("lon") * 4).cast("int").alias("j")).withColumn("x", F.explode(off)).withColumn("y", F.explode(off)).select((F.col("i") + F.col("x")).alias("i"), (F.col("j") + F.col("y")).alias("j")).distinct()
    cells = c.select((F.col("i") * 0.25).alias("cell_lat"), (F.col("j") * 0.25).alias("cell_lon"), (F.abs(F.col("i") * 3 + F.col("j")) % 7).alias("quantity"), (F.abs(F.col("i") + F.col("j") * 5) % 11).alias("cost"))
    return B.area_weighted(cells, boxes).select("id", F.round("cost", 6).alias("cost"))


@query(f"""{views('starts', 'nodes')}, p AS (SELECT start_id, key AS node, node_type, abs(s.lat - n.lat) + abs(s.lon - n.lon) AS far FROM starts s JOIN countries USING (nationkey) JOIN nodes n USING (continent))
SELECT start_id, node FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY start_id ORDER BY far, node) <= 12) UNION SELECT start_id, node FROM (SELECT * FROM p WHERE node_type = 'port' QUALIFY row_number() OVER (PARTITION BY start_id ORDER BY far, node) <= 3)""")
def nearest_nodes_and_ports(spark, d):
    """Each start's nearest nodes, and its nearest ports besides."""
    s = V.starts(spark, d).join(F.broadcast(V.countries(spark, d)), "nationkey").select(F.col("start_id").alias("id"), "lat", "lon", "continent")
    n = V.nodes(spark, d).select(F.col("key").alias("site"), "node_type", "lat", "lon", "continent")
    keep = Written(spark)
    near = X.nearest_planar(s, n, "continent", 12, keep).unionByName(X.nearest_planar(s, n.filter("node_type = 'port'"), "continent", 3, keep))
    return near.distinct().select(F.col("id").alias("start_id"), F.col("site").alias("node"))


@query(f"""{views('telemetry')} SELECT method, phase, sum(before)::BIGINT AS before, sum(after)::BIGINT AS after, max(removed) AS most, arg_max(event_id, {{'r': removed, 'e': event_id}}) AS largest, round(avg(removed / nullif(before, 0)), 6) AS share FROM telemetry GROUP BY ALL""")
def tracking_filter_summary(spark, d):
    t = V.telemetry(spark, d)
    share = F.try_divide(F.col("removed"), F.col("before"))
    return t.groupBy("method", "phase").agg(F.sum("before").alias("before"), F.sum("after").alias("after"), F.max("removed").alias("most"), F.max(F.struct("removed", "event_id"))["event_id"].alias("largest"), F.round(F.avg(share), 6).alias("share"))


@query("SELECT o_custkey AS k, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 6) AS mean, arg_min(o_orderkey, {'p': o_totalprice, 'k': o_orderkey}) AS best, arg_max(o_orderkey, {'p': o_totalprice, 'k': o_orderkey}) AS worst FROM orders GROUP BY 1")
def run_statistics(spark, d):
    x = F.struct("o_totalprice", "o_orderkey")
    return V.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.round(F.avg("o_totalprice"), 6).alias("mean"), F.min(x)["o_orderkey"].alias("best"), F.max(x)["o_orderkey"].alias("worst"))
