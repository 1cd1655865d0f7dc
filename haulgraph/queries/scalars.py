"""Scalar functions, one query each."""

from pyspark.sql import functions as F

from haulgraph.functions import cost as C
from haulgraph.functions import geo as G
from haulgraph.sources import network_view as V

from .registry import haversine, lat, lon, query, views

D = "::DOUBLE"


@query(f"""{views("nodes")} SELECT a.key AS a, b.key AS b, {haversine("a.lat", "a.lon", "b.lat", "b.lon")} AS distance_m FROM nodes a JOIN nodes b ON a.country = b.country AND a.key < b.key""", "haversine")
def haversine_query(spark, d):
    n = V.nodes(spark, d).select("key", "lat", "lon", "country")
    a, b = (n.select(F.col("key").alias(x), F.col("lat").alias(f"{x}_lat"), F.col("lon").alias(f"{x}_lon"), "country") for x in "ab")
    return a.join(b, "country").filter("a < b").select("a", "b", G.haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")).alias("distance_m"))


@query("""SELECT p_partkey AS id, round(p_retailprice * (0.08 * pow(1.08, 5 + p_size % 20::DOUBLE) / (pow(1.08, 5 + p_size % 20::DOUBLE) - 1) + 0.03) / 8000 + p_size * 0.05, 6) AS cost FROM part""")
def annuity_conversion_cost(spark, d):
    p = V.read(spark, d, "part")
    years = (5 + F.col("p_size") % 20).cast("double")
    c = C.conversion_cost(F.col("p_retailprice"), F.lit(0.03), F.lit(0.08), years, F.lit(8000.0), [(F.col("p_size").cast("double"), F.lit(0.05))])
    return p.select(F.col("p_partkey").alias("id"), F.round(c, 6).alias("cost"))


@query("""SELECT l_orderkey AS id, l_linenumber AS n, round((l_extendedprice + l_quantity) / nullif(1 - l_discount, 0), 6) AS cost,
 round(l_quantity / 10 * l_tax, 6) AS haul, CASE WHEN l_quantity <= 5 THEN 0 ELSE l_quantity * 1.5 END AS detour FROM lineitem""")
def convert_and_haul(spark, d):
    li = V.read(spark, d, "lineitem")
    q = F.col("l_quantity")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.round(C.convert(F.col("l_extendedprice"), q, 1 - F.col("l_discount")), 6).alias("cost"), F.round(C.line_haul(q * 100, F.col("l_tax")), 6).alias("haul"), C.detour(q, 5.0).alias("detour"))


@query(f"""{views("options")}, x AS (SELECT parent, n, distance_m * 1000 AS m, n % 2 = 0 AS fuel, greatest(distance_m / (17 + n) / 24{D} * 0.02{D}, CASE WHEN n % 2 = 0 THEN distance_m * 0.00001{D} ELSE 0 END) AS loss FROM options)
SELECT parent, n, round(loss, 9) AS loss, round(CASE WHEN loss < 1 THEN 50{D} / (1 - loss) + CASE WHEN fuel THEN 0 ELSE m / 1000 * 0.001{D} END END, 6) AS cost FROM x""")
def shipping_cost(spark, d):
    o = V.options(spark, d)
    m, fuel = F.col("distance_m") * 1000, F.col("n") % 2 == 0
    loss = C.ship_loss(m, (17 + F.col("n")).cast("double"), F.lit(0.02), F.lit(0.00001), fuel)
    return o.select("parent", "n", F.round(loss, 9).alias("loss"), F.round(C.ship_cost(F.lit(50.0), loss, m, F.lit(0.001), fuel), 6).alias("cost"))


@query(f"{views('nodes')} SELECT key, floor(lat * 4 + 0.5) / 4 AS lat, floor(lon * 4 + 0.5) / 4 AS lon FROM nodes")
def round_quarter(spark, d):
    return V.nodes(spark, d).select("key", G.round_quarter(F.col("lat")).alias("lat"), G.round_quarter(F.col("lon")).alias("lon"))


@query("""SELECT c_custkey AS id, c_acctbal / 20 AS cost, CASE WHEN c_acctbal / 20 > 300 THEN '>300' WHEN c_acctbal / 20 > 50 THEN '(' || (ceil(c_acctbal / 20 / 50) * 50 - 50)::INT || ',' || (ceil(c_acctbal / 20 / 50) * 50)::INT || ']' END AS category FROM customer""")
def cost_category(spark, d):
    c = V.read(spark, d, "customer")
    x = F.col("c_acctbal") / 20
    return c.select(F.col("c_custkey").alias("id"), x.alias("cost"), C.cost_category(x).alias("category"))


@query("SELECT o_orderkey AS id, round(o_totalprice * (o_orderkey % 100) / 100 / 1e6, 12) AS twh, ['kWh','MWh','GWh','TWh','PWh'][least(greatest(floor(log10(greatest(o_totalprice * 1000, 1)) / 3), 0), 4)::INT + 1] AS unit FROM orders")
def delivered_quantity(spark, d):
    o = V.read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.round(C.delivered_twh(F.col("o_totalprice"), F.col("o_orderkey") % 100), 12).alias("twh"), C.unit_scale(F.col("o_totalprice") * 1000).alias("unit"))


@query(f"SELECT c_custkey AS id, round(degrees(asin(1 - (c_custkey + 0.5{D}) * (2{D} / 150000))), 6) AS lat, round((c_custkey * 137.50776405003785{D}) % 360 - 180, 6) AS lon FROM customer")
def fibonacci_lattice(spark, d):
    la, lo = G.fibonacci_point(F.col("c_custkey"), 150_000)
    return V.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(la, 6).alias("lat"), F.round(lo, 6).alias("lon"))


@query("SELECT event_id, lower(trim(CASE event_id % 4 WHEN 0 THEN ' True ' WHEN 1 THEN 'no' WHEN 2 THEN 'ON' ELSE '0' END)) IN ('true', '1', 'yes', 'y', 'on') AS flag, coalesce((props->>'$.k')::BIGINT, -1) AS k FROM events")
def bool_coerce_json_detail(spark, d):
    e = V.read(spark, d, "events")
    text = F.when(F.col("event_id") % 4 == 0, " True ").when(F.col("event_id") % 4 == 1, "no").when(F.col("event_id") % 4 == 2, "ON").otherwise("0")
    return e.select("event_id", C.as_bool(text).alias("flag"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("k"))


@query("SELECT o_orderkey AS id, round(list_reduce([100::DOUBLE] || [x.t FOR x IN list_sort(list({'n': l_linenumber, 't': l_tax}))], lambda a, t: (a + 1) / (1 - t)), 6) AS objective FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def fold_objective(spark, d):
    """Cost carried along a route: each step adds its cost and divides by what is left."""
    li = V.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_tax").alias("t")))).alias("steps"))
    o = V.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return o.join(li, "id").select("id", F.round(F.aggregate("steps", F.lit(100.0), lambda a, x: (a + 1) / (1 - x["t"])), 6).alias("objective"))


@query(f"""WITH t AS (SELECT DISTINCT p_size % 9 AS i FROM part), c AS (SELECT a.i AS f, b.i AS t, (a.i * 7 + b.i * 3) % 50 + 1{D} AS cost, 0.6{D} + ((a.i * 5 + b.i * 11) % 40) / 100{D} AS eff FROM t a, t b WHERE a.i <> b.i AND (a.i + b.i) % 3 <> 0),
two AS (SELECT x.f, y.t, x.cost + y.cost * x.eff AS cost, x.eff * y.eff AS eff FROM c x JOIN c y ON x.t = y.f WHERE x.f <> y.t),
u AS (SELECT f, t, cost, eff FROM c UNION ALL SELECT * FROM two)
SELECT f, t, round(min(cost / eff), 6) AS unit_cost, count(*) AS ways FROM u GROUP BY f, t""")
def conversion_compose(spark, d):
    """Conversions by way of one intermediate commodity, the cheapest for each delivered unit."""
    t = V.read(spark, d, "part").select((F.col("p_size") % 9).alias("i")).distinct()
    a, b = t.select(F.col("i").alias("f")), t.select(F.col("i").alias("t"))
    cost, eff = (F.col("f") * 7 + F.col("t") * 3) % 50 + F.lit(1.0), F.lit(0.6) + ((F.col("f") * 5 + F.col("t") * 11) % 40) / 100.0
    # nine commodities at most: p_size % 9
    c = a.join(F.broadcast(b), (F.col("f") != F.col("t")) & ((F.col("f") + F.col("t")) % 3 != 0)).select("f", "t", cost.alias("cost"), eff.alias("eff"))
    y = c.select(F.col("f").alias("via"), F.col("t").alias("to"), F.col("cost").alias("cost2"), F.col("eff").alias("eff2"))
    two = c.join(y, c.t == y.via).filter("f <> to").select("f", F.col("to").alias("t"), (F.col("cost") + F.col("cost2") * F.col("eff")).alias("cost"), (F.col("eff") * F.col("eff2")).alias("eff"))
    return c.unionByName(two).groupBy("f", "t").agg(F.round(F.min(F.col("cost") / F.col("eff")), 6).alias("unit_cost"), F.count(F.lit(1)).alias("ways"))


@query(f"""SELECT c_custkey AS id, ((x > 10 AND x < 100 AND y > -40 AND y < 30) AND NOT (x >= 40 AND x < 70 AND y > 0)) AS inside FROM (SELECT c_custkey, {lon("c_custkey")} + 0.001{D} AS x, {lat("c_custkey")} + 0.001{D} AS y FROM customer)""")
def point_in_polygon(spark, d):
    ring = [(10.0, -40.0), (100.0, -40.0), (100.0, 30.0), (70.0, 30.0), (70.0, 0.0), (40.0, 0.0), (40.0, 30.0), (10.0, 30.0), (10.0, -40.0)]
    shape = F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ring))
    s = V.starts(spark, d)
    return s.select(F.col("start_id").alias("id"), G.point_in_ring(F.col("lon") + 0.001, F.col("lat") + 0.001, shape).alias("inside"))
