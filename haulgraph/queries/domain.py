"""Domain composites: start costs, state rules, steps, polygons, results and text helpers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from haulgraph.functions import cost as C
from haulgraph.functions.geo import haversine_m, point_in_ring, ring_area_m2, sphere_point
from haulgraph.operators import spatial as X
from haulgraph.operators import state as S
from haulgraph.plans import graphs as G
from haulgraph.plans import results as A
from haulgraph.plans import routing as R
from haulgraph.sources import network_view as V

from .network import _STATE, _points, _routes
from .registry import haversine, lat, lon, query, views

# --- column rules ------------------------------------------------------------------------------------------------------


@query(f"{views('options')} SELECT parent, n, node, mean FROM options WHERE NOT (node % 3 = 0 AND mean = 'N' AND node % 2 = 1)")
def hydrogen_ready(spark, d):
    """Hydrogen (node % 3 = 0) goes through gas pipes ('N') only where they are ready (even nodes)."""
    hydrogen, ready = F.col("node") % 3 == 0, F.col("node") % 2 == 0
    return V.options(spark, d).filter(~(hydrogen & (F.col("mean") == "N") & ~ready)).select("parent", "n", "node", "mean")


@query(f"{views('branches')} SELECT branch_id, round(cost - p, 4) AS adjusted FROM (SELECT *, 1000 * (ascii(commodity) - 48) * 40 AS p FROM branches) WHERE cost - p <= 0")
def profitable_subset(spark, d):
    """Branches whose cost less their commodity's strike price is nothing or less."""
    b = V.branches(spark, d)
    prices = b.select("commodity").distinct().select("commodity", (1000 * (F.ascii("commodity") - 48) * 40).alias("price"))
    adjusted = C.strike_adjusted(F.col("cost"), F.col("price"))
    return b.join(prices, "commodity").filter(adjusted <= 0).select("branch_id", F.round(adjusted, 4).alias("adjusted"))


@query(f"""{views('branches', 'starts')} SELECT s.start_id, CASE WHEN max(b.cost) IS NULL THEN 'inaccessible' WHEN count(*) FILTER (b.status = 'F') > 0 THEN 'at_destination' WHEN max(b.cost) < 200000 THEN 'no_potential' ELSE 'open' END AS outcome
FROM starts s LEFT JOIN branches b ON s.start_id = b.start_id GROUP BY s.start_id""")
def start_outcomes(spark, d):
    """Each start as inaccessible, at its destination, without potential, or open."""
    b = V.branches(spark, d).groupBy("start_id").agg(F.max("cost").alias("most"), F.count(F.when(F.col("status") == "F", 1)).alias("there"))
    outcome = F.when(F.col("most").isNull(), "inaccessible").when(F.col("there") > 0, "at_destination").when(F.col("most") < 200000, "no_potential").otherwise("open")
    return V.starts(spark, d).select("start_id").join(b, "start_id", "left").select("start_id", outcome.alias("outcome"))


@query(f"""{views('starts', 'countries')} SELECT start_id FROM starts JOIN countries USING (nationkey) WHERE continent NOT LIKE '%A' AND lat BETWEEN -50 AND 50 AND cost > 25
 AND nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal IS NOT NULL)""")
def start_acceptance(spark, d):
    """Starts of a known country and allowed continent, inside the frame, with cost data and infrastructure in the country."""
    known = V.countries(spark, d).filter(~F.col("continent").like("%A")).select("nationkey")
    priced = V.read(spark, d, "supplier").filter("s_acctbal is not null").select(F.col("s_nationkey").alias("nationkey")).distinct()
    s = V.starts(spark, d).filter(F.col("lat").between(-50, 50) & (F.col("cost") > 25))
    return s.join(known, "nationkey", "left_semi").join(priced, "nationkey", "left_semi").select("start_id")


@query(f"{views('starts')} SELECT start_id, round(CASE WHEN start_id % 3 = 0 THEN cost * 0.04 + 3 ELSE cost * 0.1 END, 6) AS heat, CASE WHEN start_id % 3 = 0 THEN 0.95::DOUBLE ELSE 0.8::DOUBLE END AS efficiency FROM starts")
def heat_switch(spark, d):
    """External heat at its price and efficiency where available, else heat from the commodity itself."""
    external = F.col("start_id") % 3 == 0
    return V.starts(spark, d).select("start_id", F.round(F.when(external, F.col("cost") * 0.04 + 3).otherwise(F.col("cost") * 0.1), 6).alias("heat"), F.when(external, F.lit(0.95)).otherwise(F.lit(0.8)).alias("efficiency"))


_CONV = "c AS (SELECT a AS c_from, z AS c_to, ((a * 13 + z * 7) % 20 + 5)::DOUBLE AS fee, 0.6::DOUBLE + ((a * 5 + z * 11) % 40) / 100::DOUBLE AS eff FROM range(4) x(a), range(4) y(z) WHERE a <> z AND (a + z) % 4 <> 3)"


def _conversions(spark):
    a, z = F.col("c_from"), F.col("c_to")
    pairs = spark.range(4).select(F.col("id").alias("c_from")).withColumn("c_to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).filter("c_from <> c_to and (c_from + c_to) % 4 <> 3")
    return pairs.select("c_from", "c_to", ((a * 13 + z * 7) % 20 + 5).cast("double").alias("fee"), (F.lit(0.6) + ((a * 5 + z * 11) % 40) / 100.0).alias("eff"))


@query(f"""{views('starts')}, {_CONV}, o AS (SELECT c_to AS commodity, fee, eff, NULL::DOUBLE AS fee2, NULL::DOUBLE AS eff2 FROM c WHERE c_from = 0 UNION ALL SELECT b.c_to, a.fee, a.eff, b.fee, b.eff FROM c a JOIN c b ON a.c_to = b.c_from WHERE a.c_from = 0 AND b.c_to <> 0)
SELECT start_id, commodity, round(min(x), 6) AS cost, round(arg_min(e, x), 6) AS efficiency FROM (SELECT start_id, commodity, CASE WHEN fee2 IS NULL THEN (cost + fee) / eff ELSE ((cost + fee) / eff + fee2) / eff2 END AS x, eff * coalesce(eff2, 1) AS e FROM starts, o) GROUP BY ALL
UNION ALL SELECT start_id, 0, round(cost, 6), 1 FROM starts""")
def start_production_cost(spark, d):
    """Start branches: each start's least cost of every commodity by none, one or two conversions, with the efficiency."""
    c = _conversions(spark)
    first = c.filter("c_from = 0").select(F.col("c_to").alias("via"), F.col("fee").alias("f1"), F.col("eff").alias("e1"))
    second = first.join(c, F.col("via") == F.col("c_from")).filter("c_to <> 0").select(F.col("c_to").alias("commodity"), "f1", "e1", F.col("fee").alias("f2"), F.col("eff").alias("e2"))
    ways = first.select(F.col("via").alias("commodity"), "f1", "e1", F.lit(0.0).alias("f2"), F.lit(1.0).alias("e2")).unionByName(second)
    none = spark.createDataFrame([(0, 0.0, 1.0, 0.0, 1.0)], "commodity long, f1 double, e1 double, f2 double, e2 double")
    x = C.convert(C.convert(F.col("cost"), F.col("f1"), F.col("e1")), F.col("f2"), F.col("e2"))
    # the ways are as many as pairs of conversions, whatever the starts
    all_ways = V.starts(spark, d).select("start_id", "cost").crossJoin(F.broadcast(ways.unionByName(none))).select("start_id", "commodity", x.alias("x"), (F.col("e1") * F.col("e2")).alias("e")).filter(C.is_finite(F.col("x")))
    return all_ways.groupBy("start_id", "commodity").agg(F.round(F.min("x"), 6).alias("cost"), F.round(F.min_by("e", "x"), 6).alias("efficiency"))


@query("""WITH c AS (SELECT (p_size % 9)::BIGINT AS commodity, (p_partkey % 9)::BIGINT AS target, (p_partkey % 20 + 5)::DOUBLE AS fee, 0.6::DOUBLE + (p_partkey % 40) / 100::DOUBLE AS eff FROM part WHERE p_size % 9 <> p_partkey % 9)
SELECT commodity, list_sort(list(DISTINCT target)) AS options, min(fee) AS least_fee, round(min(eff), 6) AS least_efficiency, commodity <> 2 AS hydrogen_ready, commodity % 2 = 0 AS new_pipes FROM c GROUP BY commodity""")
def commodity_dimension(spark, d):
    """Commodities with their conversions, least cost and efficiency, and flags. Every part is a conversion between two of nine."""
    p, key = V.read(spark, d, "part"), F.col("p_partkey")
    c = p.select((F.col("p_size") % 9).cast("long").alias("commodity"), (key % 9).cast("long").alias("to"), (key % 20 + 5).cast("double").alias("fee"), (F.lit(0.6) + (key % 40) / 100.0).alias("eff")).filter("commodity <> to")
    return A.commodity_dimension(c, {"hydrogen_ready": F.col("commodity") != 2, "new_pipes": F.col("commodity") % 2 == 0})


@query(f"{views('nodes')} SELECT key AS node, min((key * 31 + z * 3) % 50 + 1 - 2 * z)::DOUBLE AS least FROM nodes, range(1, 3) y(z) WHERE convertible GROUP BY key")
def pipeline_conversion_bound(spark, d):
    """The least conversion to a pipeline commodity (1 or 2) at each node, less its strike price."""
    n = V.nodes(spark, d).filter("convertible").select(F.col("key").alias("node"))
    z = F.explode(F.array(F.lit(1), F.lit(2))).alias("z")
    return n.select("node", z).groupBy("node").agg(F.min((F.col("node") * 31 + F.col("z") * 3) % 50 + 1 - 2 * F.col("z")).cast("double").alias("least"))


@query(f"{views('branches')} SELECT branch_id, CASE WHEN a <= b AND a <= c THEN 'road' WHEN b <= c THEN 'new_pipe' ELSE 'ship' END AS mean, round(least(a, b, c), 6) AS cost FROM (SELECT branch_id, cost * 1.02 AS a, cost + 4000 AS b, cost * 0.99 + 5000 AS c FROM branches)")
def cheapest_alternative(spark, d):
    """The least of alternative columns with the name of the winner, the first of equals."""
    cost = F.col("cost")
    ways = F.array(*(F.struct(x.alias("cost"), F.lit(k).alias("k"), F.lit(n).alias("mean")) for k, (n, x) in enumerate((("road", cost * 1.02), ("new_pipe", cost + 4000), ("ship", cost * 0.99 + 5000)))))
    return V.branches(spark, d).select("branch_id", F.array_min(ways).alias("w")).select("branch_id", "w.mean", F.round("w.cost", 6).alias("cost"))


@query(f"{views('options')} SELECT parent, n, round(rate * 1e6 / distance_m, 6) AS per_m, round(loss * 1e6 / nullif(rate, 0), 6) AS implied_m FROM options")
def implied_distance(spark, d):
    """What distance an edge's cost implies at a rate; none without a rate."""
    return V.options(spark, d).select("parent", "n", F.round(F.col("rate") * 1e6 / F.col("distance_m"), 6).alias("per_m"), F.round(F.try_divide(F.col("loss") * 1e6, F.col("rate")), 6).alias("implied_m"))


@query("SELECT c_custkey AS id, lower(trim(c_name)) AS name, substr(replace(c_name, '#', '_'), 1, 14) AS short, md5(concat_ws('|', c_custkey::VARCHAR, c_nationkey::VARCHAR, c_mktsegment)) AS branch_key FROM customer")
def text_keys(spark, d):
    """Normalised names, replaced and cut text, and a surrogate key that any run derives again."""
    c = V.read(spark, d, "customer")
    key = F.md5(F.concat_ws("|", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), "c_mktsegment"))
    return c.select(F.col("c_custkey").alias("id"), F.lower(F.trim("c_name")).alias("name"), F.substring(F.replace("c_name", F.lit("#"), F.lit("_")), 1, 14).alias("short"), key.alias("branch_key"))


@query("SELECT c_custkey AS id, (('0x' || substr(md5('42-' || c_custkey::VARCHAR), 1, 8))::BIGINT) % 16 AS chunk, row_number() OVER (PARTITION BY (('0x' || substr(md5('42-' || c_custkey::VARCHAR), 1, 8))::BIGINT) % 16 ORDER BY md5('42-' || c_custkey::VARCHAR)) AS place FROM customer")
def shuffled_chunks(spark, d):
    """A permutation by seeded hash, dealt into chunks, without a sort of everything."""
    h = F.md5(F.concat(F.lit("42-"), F.col("c_custkey").cast("string")))
    c = V.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), h.alias("h"), (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % 16).alias("chunk"))
    return c.select("id", "chunk", F.row_number().over(Window.partitionBy("chunk").orderBy("h")).alias("place"))


@query(f"{views('starts')} SELECT start_id, nationkey, row_number() OVER (PARTITION BY nationkey ORDER BY coalesce(CASE WHEN start_id % 4 = 0 THEN NULL ELSE cost END, 'inf'::DOUBLE), start_id) AS place FROM starts")
def location_order(spark, d):
    """Locations of each country by known cost, those without one last, then by id."""
    known = F.coalesce(F.when(F.col("start_id") % 4 != 0, F.col("cost")), F.lit(C.INF))
    return V.starts(spark, d).select("start_id", "nationkey", F.row_number().over(Window.partitionBy("nationkey").orderBy(known, "start_id")).alias("place"))


@query("SELECT event_id, CASE WHEN value > 90 THEN 'inf' WHEN value < 5 THEN 'nan' ELSE round(value, 2)::VARCHAR END AS value, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS record, [event_type] AS as_list, CASE WHEN user_id % 2 = 0 THEN list_value(user_id, event_id) ELSE list_value(event_id) END AS history FROM events")
def event_records(spark, d):
    """Events as JSON records: non-finite numbers as text, single values as lists, a history with the new step appended."""
    e, v = V.read(spark, d, "events"), F.col("value")
    number = F.when(v > 90, F.lit(C.INF)).when(v < 5, F.lit(float("nan"))).otherwise(F.round("value", 2))
    text = F.when(F.isnan(number), "nan").when(number == C.INF, "inf").otherwise(number.cast("string"))
    history = F.array_append(F.when(F.col("user_id") % 2 == 0, F.array("user_id")).otherwise(F.array().cast("array<bigint>")), F.col("event_id"))
    return e.select("event_id", text.alias("value"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("record"), F.array("event_type").alias("as_list"), history.alias("history"))


@query("SELECT event_id, 'k' AS name, (props->>'$.k')::VARCHAR AS value FROM events")
def dict_rows(spark, d):
    """A row for each entry of a JSON object."""
    e = V.read(spark, d, "events")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))


@query("SELECT i, degrees(asin(2 * u - 1)) AS lat, 360 * v - 180 AS lon FROM (SELECT i, ('0x' || substr(md5(i::VARCHAR || '#lat'), 1, 12))::BIGINT / 281474976710656::DOUBLE AS u, ('0x' || substr(md5(i::VARCHAR || '#lon'), 1, 12))::BIGINT / 281474976710656::DOUBLE AS v FROM (SELECT s_suppkey AS i FROM supplier))")
def uniform_sphere(spark, d):
    """Points spread evenly over the sphere, the same in every run."""
    i = F.col("s_suppkey")
    return V.read(spark, d, "supplier").select(i.alias("i"), *(x.alias(n) for x, n in zip(sphere_point(i), ("lat", "lon"), strict=True)))


# --- spatial -----------------------------------------------------------------------------------------------------------

_BOXES = "boxes AS (SELECT n_nationkey AS nationkey, n_name AS country, -60 + (n_nationkey % 5) * 24 AS south, -180 + (n_nationkey // 5) * 72 AS west FROM nation)"


def _polygons(spark, d):
    """A box of 24 by 72 degrees for each nation, as a closed ring."""
    n = V.read(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("country"), (F.lit(-60.0) + (F.col("n_nationkey") % 5) * 24).alias("south"), (F.lit(-180.0) + F.floor(F.col("n_nationkey") / 5) * 72).alias("west"))
    corner = lambda x, y: F.struct((F.col("west") + x).cast("double").alias("lon"), (F.col("south") + y).cast("double").alias("lat"))
    return n.withColumn("ring", F.array(corner(0, 0), corner(72, 0), corner(72, 24), corner(0, 24), corner(0, 0)))


@query(f"{views('starts')}, {_BOXES} SELECT start_id, b.nationkey AS found, b.country FROM starts s LEFT JOIN boxes b ON s.lat >= b.south AND s.lat < b.south + 24 AND s.lon >= b.west AND s.lon < b.west + 72")
def polygon_join(spark, d):
    """Points to polygons by grid cells, each pair of a cell tested by the ring; points in none have nulls."""
    found = X.in_polygons(V.starts(spark, d).select(F.col("start_id").alias("id"), "lat", "lon"), _polygons(spark, d).select("nationkey", "country", "ring"), 6.0)
    return V.starts(spark, d).select("start_id").join(found.select(F.col("id").alias("start_id"), F.col("nationkey").alias("found"), "country"), "start_id", "left")


@query(f"{views('nodes')}, {_BOXES} SELECT key AS node, b.country AS inside FROM nodes n JOIN boxes b ON n.lat >= b.south AND n.lat < b.south + 24 AND n.lon >= b.west AND n.lon < b.west + 72 WHERE n.lat BETWEEN -30 AND 55 AND n.lon BETWEEN -100 AND 120")
def country_attach(spark, d):
    """Infrastructure of a frame with the country it lies in: the frame's filter comes first."""
    n = V.nodes(spark, d).filter(F.col("lat").between(-30, 55) & F.col("lon").between(-100, 120)).select(F.col("key").alias("id"), "lat", "lon")
    return X.in_polygons(n, _polygons(spark, d).select("country", "ring"), 6.0).select(F.col("id").alias("node"), F.col("country").alias("inside"))


@query(f"""{views('starts', 'nodes')}, p AS (SELECT start_id, n.continent, {haversine('s.lat', 's.lon', 'n.lat', 'n.lon')} AS distance_m, key FROM starts s, nodes n)
SELECT s.start_id, coalesce(n.continent, q.continent, 'PREVIOUS') AS continent FROM starts s LEFT JOIN (SELECT key, continent FROM nodes WHERE key % 2 = 0) n ON s.start_id = n.key
LEFT JOIN (SELECT start_id, arg_min(continent, {{'d': distance_m, 'k': key}}) AS continent FROM p WHERE distance_m <= 1000000 GROUP BY start_id) q ON q.start_id = s.start_id""")
def continent_maintenance(spark, d):
    """A branch's continent: by its node, else that of the nearest region within a cutoff, else the one before."""
    s, n = V.starts(spark, d), V.nodes(spark, d)
    near = X.nearest_within(_points(s, "start_id", "l"), _points(n, "key", "r"), 1_000_000.0, G.Written(spark))
    first = near.select(F.col("l_id").alias("start_id"), "r_id")
    near_by = first.join(n.select(F.col("key").alias("r_id"), F.col("continent").alias("near_by")), "r_id").select("start_id", "near_by")
    mapped = n.filter("key % 2 = 0").select(F.col("key").alias("start_id"), "continent")
    return s.select("start_id").join(mapped, "start_id", "left").join(near_by, "start_id", "left").select("start_id", F.coalesce("continent", "near_by", F.lit("PREVIOUS")).alias("continent"))


@query(f"""{views('nodes', 'starts')}, p AS (SELECT DISTINCT n.key FROM nodes n JOIN nodes t ON t.key % 5 = 2 WHERE n.key % 5 <> 2 AND {haversine('n.lat', 'n.lon', 't.lat', 't.lon')} <= 700000)
SELECT key AS node, key % 5 = 2 AS member FROM nodes WHERE key % 5 = 2 OR key IN (SELECT key FROM p)""")
def destination_membership(spark, d):
    """Nodes of the destination, or within a tolerance of it."""
    n = V.nodes(spark, d)
    there = n.filter("key % 5 = 2")
    close = X.within_distance(_points(n.filter("key % 5 <> 2"), "key", "l"), _points(there, "key", "r"), 700_000.0).select(F.col("l_id").alias("node")).distinct()
    return there.select(F.col("key").alias("node"), F.lit(True).alias("member")).unionByName(close.withColumn("member", F.lit(False)))


@query(f"""{views('nodes')}, p AS (SELECT n.key, min({haversine('n.lat', 'n.lon', 't.lat', 't.lon')}) AS m FROM nodes n JOIN nodes t ON t.node_type = 'port' GROUP BY n.key) SELECT n.key AS node, n.key % 6 < 3 OR m <= 600000 AS water FROM nodes n JOIN p ON p.key = n.key""")
def water_available(spark, d):
    """Water where scarcity scores under 3, or the coast (here a port) is near."""
    n = V.nodes(spark, d)
    coast = X.within_distance(_points(n, "key", "l"), _points(n.filter("node_type = 'port'"), "key", "r"), 600_000.0).select(F.col("l_id").alias("key")).distinct().withColumn("coast", F.lit(True))
    return n.join(coast, "key", "left").select(F.col("key").alias("node"), ((F.col("key") % 6 < 3) | F.coalesce("coast", F.lit(False))).alias("water"))


@query("SELECT c_nationkey AS nationkey, arg_max(c_custkey, {'a': c_acctbal, 'k': c_custkey}) AS part, max(c_acctbal) AS area FROM customer WHERE c_nationkey % 3 <> 1 GROUP BY c_nationkey")
def largest_part(spark, d):
    """The largest part of each selected country."""
    c = V.read(spark, d, "customer").filter("c_nationkey % 3 <> 1")
    return c.groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.max(F.struct("c_acctbal", "c_custkey")).alias("m")).select("nationkey", F.col("m.c_custkey").alias("part"), F.col("m.c_acctbal").alias("area"))


_RING = f"{views('steps')}, q AS (SELECT route, n, {lat('node')} AS lat, {lon('node')} AS lon, lead({lat('node')}) OVER w AS lat2, lead({lon('node')}) OVER w AS lon2, first_value({lat('node')}) OVER w AS lat0, first_value({lon('node')}) OVER w AS lon0 FROM steps WINDOW w AS (PARTITION BY route ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query(f"{_RING} SELECT route, sum({haversine('lat', 'lon', 'lat2', 'lon2')}) AS length_m FROM q WHERE lat2 IS NOT NULL GROUP BY route")
def polyline_length(spark, d):
    """The length of each route over its nodes in order."""
    w = Window.partitionBy("route").orderBy("n")
    s = V.steps(spark, d).withColumn("next", F.lead("node").over(w)).filter("next is not null")
    far = haversine_m(V.lat_of(F.col("node")), V.lon_of(F.col("node")), V.lat_of(F.col("next")), V.lon_of(F.col("next")))
    return s.groupBy("route").agg(F.sum(far).alias("length_m"))


@query(f"""{views('steps')}, q AS (SELECT route, n, {lat('node')} AS y, {lon('node')} AS x, count(*) OVER (PARTITION BY route) AS c FROM steps),
r AS (SELECT a.route, (radians(b.x) - radians(a.x)) * (2 + sin(radians(a.y)) + sin(radians(b.y))) AS t FROM q a JOIN q b ON a.route = b.route AND b.n = a.n % a.c + 1 WHERE a.c >= 3)
SELECT route, round(abs(sum(t)) * 6371000::DOUBLE * 6371000 / 2 / 1e6, 0) AS area_km2 FROM r GROUP BY route""")
def ring_area(spark, d):
    """The area on the sphere of the ring through each route's nodes, in square kilometres."""
    point = F.struct("n", V.lon_of(F.col("node")).alias("lon"), V.lat_of(F.col("node")).alias("lat"))
    rings = V.steps(spark, d).groupBy("route").agg(F.array_sort(F.collect_list(point)).alias("ring")).filter(F.size("ring") >= 3)
    return rings.select("route", F.round(ring_area_m2(F.col("ring")) / 1e6, 0).alias("area_km2"))


# --- graph and steps ---------------------------------------------------------------------------------------------------

_ONE = "f AS (SELECT start_id, start_id % (SELECT count(*) FROM supplier) AS node, 0::BIGINT AS commodity, cost, start_id % 2 = 0 AS free, start_id % 3 = 0 AS shipped, CASE WHEN start_id % 5 = 0 THEN ['PG_1', 'PG_2', 'PL_3'] ELSE []::VARCHAR[] END AS visited FROM starts)"


def _one_step(spark, d, kind):
    seeds, tables, _ = _routes(spark, d)
    odd = F.when(F.col("start_id") % 5 == 0, F.array(F.lit("PG_1"), F.lit("PG_2"), F.lit("PL_3"))).otherwise(F.array().cast("array<string>"))
    front = seeds.select("start_id", "node", "commodity", (F.col("start_id") % 2 == 0).alias("free"), "cost", F.lit(0).alias("hops"), (F.col("start_id") % 3 == 0).alias("shipped"), odd.alias("visited"), F.lit(None).cast("string").alias("riding"))
    only = {k: t if k == kind else t.limit(0) for k, t in tables.items()}
    return R.steps(front, only).select("start_id", "node", "commodity", F.round("cost", 6).alias("cost"), "free", "shipped", F.array_join("visited", ",").alias("visited"))


@query(f"{_STATE} {_ONE} SELECT start_id, f.node, to_c AS commodity, round((cost + fee) / efficiency, 6) AS cost, free, shipped, array_to_string(visited, ',') AS visited FROM f JOIN v ON f.node = v.node AND f.commodity = v.commodity")
def conversion_step(spark, d):
    return _one_step(spark, d, "conversions")


@query(f"{_STATE} {_ONE} SELECT start_id, dst AS node, f.commodity, round((cost + fee) / (1 - loss), 6) AS cost, true AS free, shipped, array_to_string(list_sort(list_distinct(list_append(visited, network))), ',') AS visited FROM f JOIN s ON f.node = s.src AND f.commodity = s.commodity WHERE NOT list_contains(visited, network)")
def network_step(spark, d):
    """Along segments of networks not visited before."""
    return _one_step(spark, d, "segments")


@query(f"{_STATE} {_ONE} SELECT start_id, dst AS node, commodity, round(cost, 6) AS cost, free, shipped, array_to_string(visited, ',') AS visited FROM f JOIN x ON f.node = x.src")
def transfer_step(spark, d):
    """To co-located nodes of other networks, at no cost."""
    return _one_step(spark, d, "transfers")


@query(f"{_STATE} {_ONE} SELECT start_id, dst AS node, f.commodity, round(cost + fee, 6) AS cost, false AS free, shipped, array_to_string(visited, ',') AS visited FROM f JOIN j ON f.node = j.src AND f.commodity = j.commodity WHERE free")
def connector_step(spark, d):
    """Road or new pipe, never twice in a row."""
    return _one_step(spark, d, "connectors")


@query(f"{_STATE} {_ONE} SELECT start_id, dst AS node, f.commodity, round((cost + fee) / (1 - loss), 6) AS cost, true AS free, true AS shipped, array_to_string(visited, ',') AS visited FROM f JOIN h ON f.node = h.src AND f.commodity = h.commodity WHERE NOT shipped")
def ship_step(spark, d):
    """Port to port with losses, once."""
    return _one_step(spark, d, "ships")


@query(f"{views('branches')} SELECT branch_id FROM (SELECT *, row_number() OVER (PARTITION BY node, commodity, start_id % 2 ORDER BY cost, branch_id) AS k FROM branches) WHERE k = 1")
def dominance_state(spark, d):
    """The cheapest branch of each node, commodity and connector state."""
    b = V.branches(spark, d).withColumn("free", F.col("start_id") % 2)
    return S.keep_best(b, ["node", "commodity", "free"], ["cost", "branch_id"]).select("branch_id")


@query(f"{views('branches')} SELECT start_id, min(cost) AS cost, arg_min(branch_id, {{'c': cost, 'b': branch_id}}) AS branch_id FROM branches GROUP BY start_id")
def upsert_best(spark, d):
    """New states against the known best of their key."""
    b = V.branches(spark, d).select("start_id", "cost", "branch_id")
    return S.upsert_best(b.filter("branch_id % 2 = 0"), b.filter("branch_id % 2 = 1"), ["start_id"], "cost", "branch_id")


@query(f"{_STATE} near AS (SELECT src, list_sort(list(dst)) AS others FROM x GROUP BY src), w AS (SELECT o_orderkey AS branch_id, o_custkey % 97 AS node FROM orders) SELECT branch_id, unnest(others) AS other FROM w JOIN near ON w.node = near.src")
def adjacency_join(spark, d):
    """Branches to the listed neighbours of their node."""
    near = _routes(spark, d)[1]["transfers"].groupBy("node").agg(F.collect_list("dst").alias("others"))
    return V.branches(spark, d).select("branch_id", "node").join(near, "node").select("branch_id", F.explode("others").alias("other"))


@query(f"{views('edges')}, z AS (SELECT key, graph_id FROM nodes WHERE graph_id IS NOT NULL), p AS (SELECT graph_id, key, row_number() OVER (PARTITION BY graph_id ORDER BY key) AS at FROM z) SELECT f.key AS source, t.key AS node, (t.at - 1)::INT AS hops, (SELECT string_agg(m.key::VARCHAR, '>' ORDER BY m.at) FROM p m WHERE m.graph_id = t.graph_id AND m.at <= t.at) AS path FROM p t JOIN p f ON f.graph_id = t.graph_id AND f.at = 1 WHERE t.graph_id IN (SELECT graph_id FROM edges)")
def bfs_path(spark, d):
    """Paths of fewest hops from the first node of each network. The networks are chains, so the SQL lists their nodes in order."""
    e = V.edges(spark, d)
    first = e.groupBy("graph_id").agg(F.min("src").alias("source")).select("source", F.col("source").alias("node"))
    found = G.fewest_hops(S.both_ways(e.select("src", "dst"), "src", "dst"), first)
    return found.select("source", "node", "hops", F.array_join("path", ">").alias("path"))


@query(f"""{views('edges')}, z AS (SELECT n.graph_id, n.key, e.distance_m FROM nodes n LEFT JOIN edges e ON e.dst = n.key WHERE n.graph_id IS NOT NULL),
g AS (SELECT graph_id, key, sum(CASE WHEN distance_m < 9000000 THEN 0 ELSE 1 END) OVER (PARTITION BY graph_id ORDER BY key) AS run, distance_m FROM z), r AS (SELECT graph_id, key, min(key) OVER (PARTITION BY graph_id, run) AS root FROM g)
SELECT least(a.root, b.root) AS src, greatest(a.root, b.root) AS dst, min(distance_m) AS distance_m FROM edges e JOIN r a ON a.key = e.src JOIN r b ON b.key = e.dst WHERE a.root <> b.root GROUP BY 1, 2""")
def short_edge_contraction(spark, d):
    """Nodes that short edges tie together become one."""
    return G.contract(V.edges(spark, d).select("src", "dst", "distance_m"), 9_000_000.0)


@query(f"{_STATE} t AS (SELECT src, dst FROM x UNION SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), k AS (SELECT 1::BIGINT AS node UNION SELECT dst FROM k JOIN t ON node = src) SELECT node FROM k")
def colocated_fixpoint(spark, d):
    """Networks and their co-located networks, until none is new."""
    t = _routes(spark, d)[1]
    e = t["segments"].select(F.col("node").alias("src"), "dst").unionByName(t["transfers"].select(F.col("node").alias("src"), "dst")).distinct()
    return G.reachable(G.cut(e), spark.range(1, 2).withColumnRenamed("id", "node"))


@query(f"{views('edges')} SELECT src, dst FROM edges WHERE NOT (src % 5 <= 2 AND dst % 5 <= 2)")
def drop_sink_transport(spark, d):
    """Edges but those between accepted sinks."""
    sinks = V.nodes(spark, d).filter("key % 5 <= 2").select("key")
    e = V.edges(spark, d).select("src", "dst")
    inner = e.join(sinks, e.src == sinks.key, "left_semi").join(sinks, e.dst == sinks.key, "left_semi")
    return e.join(inner.select("src", "dst"), ["src", "dst"], "left_anti")


@query(f"""{views('nodes', 'edges', 'starts')}, m AS (SELECT 'start' AS kind, start_id % 50 AS src, start_id AS dst, cost FROM starts WHERE cost < 80 UNION ALL SELECT 'transport', src, dst, distance_m / 1000 * 0.01::DOUBLE FROM edges UNION ALL SELECT 'conversion', key, key, (key % 40 + 1)::DOUBLE FROM nodes WHERE convertible UNION ALL SELECT 'sink', key, -1, 0 FROM nodes WHERE key % 5 = 2)
SELECT kind, count(*) AS n, round(min(cost), 6) AS least, round(max(cost), 6) AS most FROM m WHERE isfinite(cost) GROUP BY kind""")
def run_assembly(spark, d):
    """The edges of a model run: starts, transport, conversions and sinks, filtered and summed up."""
    km, none = F.col("distance_m") / 1000 * 0.01, F.lit(-1).cast("long")
    n = V.nodes(spark, d)
    part = lambda df, kind, src, dst, cost: df.select(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), cost.alias("cost"))
    every = part(V.starts(spark, d).filter("cost < 80"), "start", F.col("start_id") % 50, F.col("start_id"), F.col("cost"))
    every = every.unionByName(part(V.edges(spark, d), "transport", F.col("src"), F.col("dst"), km))
    every = every.unionByName(part(n.filter("convertible"), "conversion", F.col("key"), F.col("key"), (F.col("key") % 40 + 1).cast("double")))
    every = every.unionByName(part(n.filter("key % 5 = 2"), "sink", F.col("key"), none, F.lit(0.0)))
    return every.filter(C.is_finite(F.col("cost"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("cost"), 6).alias("least"), F.round(F.max("cost"), 6).alias("most"))


@query(f"""{views('nodes', 'edges')} SELECT e.graph_id, src, dst, distance_m FROM edges e WHERE e.graph_id IN ('PG_3', 'PL_4')""")
def distance_lookup(spark, d):
    """Distances written by network and read again for some: only their folders are listed."""
    from haulgraph.sources.files import partitioned

    at = partitioned(V.edges(spark, d), "graph_id")
    return at.filter(F.col("graph_id").isin("PG_3", "PL_4")).select("graph_id", "src", "dst", "distance_m")


# --- state, shipping and costs -----------------------------------------------------------------------------------------


@query(f"{views('nodes')} SELECT key AS node FROM nodes WHERE node_type = 'port' AND (CASE WHEN continent IN ('ASIA', 'EUROPE', 'AFRICA') THEN 'OLD' ELSE continent END) IN (SELECT CASE WHEN continent IN ('ASIA', 'EUROPE', 'AFRICA') THEN 'OLD' ELSE continent END FROM nodes WHERE key % 11 = 2)")
def shipping_targets(spark, d):
    """Ports on the destinations' continents, those of the old world being one."""
    n = V.nodes(spark, d).withColumn("land", F.when(F.col("continent").isin("ASIA", "EUROPE", "AFRICA"), "OLD").otherwise(F.col("continent")))
    return n.filter("node_type = 'port'").join(n.filter("key % 11 = 2").select("land").distinct(), "land", "left_semi").select(F.col("key").alias("node"))


@query(f"{views('starts', 'countries')}, r AS (SELECT a.continent AS c, b.continent AS reach FROM (SELECT DISTINCT continent FROM countries) a, (SELECT DISTINCT continent FROM countries) b WHERE length(a.continent) <= length(b.continent)) SELECT start_id % 100 AS batch, list_sort(list(DISTINCT reach)) AS reach FROM starts JOIN countries USING (nationkey) JOIN r ON c = continent GROUP BY 1")
def continent_reach(spark, d):
    """The continents that a batch of branches can reach."""
    c = V.countries(spark, d)
    land = c.select("continent").distinct()
    reach = land.crossJoin(land.withColumnRenamed("continent", "reach")).filter("length(continent) <= length(reach)")  # a pair of continents each
    s = V.starts(spark, d).join(F.broadcast(c), "nationkey").select((F.col("start_id") % 100).alias("batch"), "continent").distinct()
    return s.join(reach, "continent").groupBy("batch").agg(F.array_sort(F.collect_set("reach")).alias("reach"))


@query(f"{views('nodes')} SELECT key AS node, least(key * 1000, {haversine('lat', 'lon', '0', '0')}) AS distance_m FROM nodes")
def nearest_adjusted(spark, d):
    """The nearest target, or the destination where that is nearer."""
    return V.nodes(spark, d).select(F.col("key").alias("node"), F.least((F.col("key") * 1000).cast("double"), haversine_m(F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(0.0))).alias("distance_m"))


@query(f"{views('starts', 'branches')} SELECT branch_id, b.start_id, lat, lon, nationkey, round(s.cost, 6) AS start_cost FROM branches b JOIN starts s USING (start_id) WHERE status = 'F'")
def start_metadata(spark, d):
    """Solutions with their start's data."""
    return V.branches(spark, d).filter("status = 'F'").select("branch_id", "start_id").join(V.starts(spark, d).withColumnRenamed("cost", "start_cost"), "start_id").select("branch_id", "start_id", "lat", "lon", "nationkey", F.round("start_cost", 6).alias("start_cost"))


@query("""WITH l AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS own FROM supplier), c AS (SELECT s_nationkey, avg(own) AS mean FROM l GROUP BY s_nationkey)
SELECT s_suppkey AS node, round(coalesce(own, mean, 5000.0), 6) AS cost, CASE WHEN own IS NOT NULL THEN 'location' WHEN mean IS NOT NULL THEN 'country' ELSE 'uniform' END AS source FROM l JOIN c USING (s_nationkey)""")
def infrastructure_costs(spark, d):
    """A node's cost by location, else its country's mean, else uniform."""
    s = V.read(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal")).alias("own"))
    out = s.join(s.groupBy("s_nationkey").agg(F.avg("own").alias("mean")), "s_nationkey")
    return out.select(F.col("s_suppkey").alias("node"), F.round(F.coalesce("own", "mean", F.lit(5000.0)), 6).alias("cost"), F.when(F.col("own").isNotNull(), "location").when(F.col("mean").isNotNull(), "country").otherwise("uniform").alias("source"))


# --- results -----------------------------------------------------------------------------------------------------------


@query(f"{views('steps')} SELECT route, arg_max(flag, n) FILTER (status <> 'O') AS commodity, count(*) AS steps FROM steps GROUP BY route")
def final_commodity(spark, d):
    """The commodity of each route's last step that is no transport."""
    s = V.steps(spark, d)
    return s.groupBy("route").agg(F.max_by("flag", F.when(F.col("status") != "O", F.col("n"))).alias("commodity"), F.count(F.lit(1)).alias("steps"))


@query(f"{views('steps')} SELECT route, list(node || '>' || next || ':' || flag ORDER BY n) AS keys FROM (SELECT *, lead(node) OVER (PARTITION BY route ORDER BY n) AS next FROM steps) WHERE next IS NOT NULL GROUP BY route")
def route_edge_keys(spark, d):
    """A route as keys of model edges."""
    r = V.steps(spark, d).groupBy("route").agg(F.array_sort(F.collect_list(F.struct("n", "node", "flag"))).alias("s")).filter(F.size("s") > 1)
    key = lambda a, b: F.concat(a["node"].cast("string"), F.lit(">"), b["node"].cast("string"), F.lit(":"), a["flag"])
    return r.select("route", F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: key(F.element_at("s", i), F.element_at("s", i + 1))).alias("keys"))


@query(f"""{views('steps', 'branches', 'starts')}, r AS (SELECT route, list(node ORDER BY n) AS nodes, round(sum(total * tax), 4) AS fees, list_sort(list(DISTINCT flag)) AS commodities FROM steps GROUP BY route),
b AS (SELECT *, row_number() OVER (PARTITION BY start_id ORDER BY cost, branch_id) AS k FROM branches)
SELECT s.start_id, lat, lon, round(b.cost, 6) AS cost, fees, nodes, commodities, b.branch_id IS NOT NULL AS solved FROM starts s LEFT JOIN b ON b.start_id = s.start_id AND k = 1 LEFT JOIN r ON r.route = b.branch_id""")
def result_table(spark, d):
    """One row for each start: its cheapest solution with cost parts, route and commodities."""
    step = V.steps(spark, d).groupBy(F.col("route").alias("branch_id")).agg(F.array_sort(F.collect_list(F.struct("n", "node"))).alias("s"), F.round(F.sum(F.col("total") * F.col("tax")), 4).alias("fees"), F.array_sort(F.collect_set("flag")).alias("commodities"))
    best = S.keep_best(V.branches(spark, d), ["start_id"], ["cost", "branch_id"]).select("start_id", "branch_id", "cost")
    out = V.starts(spark, d).select("start_id", "lat", "lon").join(best, "start_id", "left").join(step, "branch_id", "left")
    return out.select("start_id", "lat", "lon", F.round("cost", 6).alias("cost"), "fees", F.transform("s", lambda x: x["node"]).alias("nodes"), "commodities", F.col("branch_id").isNotNull().alias("solved"))


@query(f"""{views('branches')}, a AS (SELECT branch_id, commodity, cost - 40000 * (ascii(commodity) - 48) AS adjusted FROM branches), q AS (SELECT commodity, min(adjusted) AS low, max(adjusted) AS high FROM a GROUP BY commodity)
SELECT branch_id, round(adjusted, 4) AS adjusted, least(9, floor(10 * (adjusted - low) / nullif(high - low, 0)))::INT AS shade FROM a JOIN q USING (commodity)""")
def result_loading(spark, d):
    """Results with adjusted costs and their place in the colour range of their commodity."""
    a = V.branches(spark, d).select("branch_id", "commodity", C.strike_adjusted(F.col("cost"), (40000 * (F.ascii("commodity") - 48)).cast("double")).alias("adjusted"))
    q = a.groupBy("commodity").agg(F.min("adjusted").alias("low"), F.max("adjusted").alias("high"))
    shade = F.least(F.lit(9), F.floor(F.try_divide(10 * (F.col("adjusted") - F.col("low")), F.col("high") - F.col("low")))).cast("int")
    return a.join(q, "commodity").select("branch_id", F.round("adjusted", 4).alias("adjusted"), shade.alias("shade"))


@query(f"{views('steps')} SELECT flag AS source, next AS target, count(*) AS n, round(sum(quantity), 4) AS weight, round(sum(quantity * tax), 4) AS lost FROM (SELECT *, lead(flag) OVER (PARTITION BY route ORDER BY n) AS next FROM steps) WHERE next IS NOT NULL GROUP BY ALL")
def sankey_table(spark, d):
    """Flows between consecutive sections with weights and losses."""
    s = V.steps(spark, d).withColumn("next", F.lead("flag").over(Window.partitionBy("route").orderBy("n"))).filter("next is not null")
    return s.groupBy(F.col("flag").alias("source"), F.col("next").alias("target")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("quantity"), 4).alias("weight"), F.round(F.sum(F.col("quantity") * F.col("tax")), 4).alias("lost"))


@query(f"""{views('steps')}, g AS (SELECT route, string_agg(flag, '-' ORDER BY n) AS signature FROM steps GROUP BY route)
SELECT signature, n AS section, count(*) AS routes, round(min(total), 4) AS least, round(avg(total), 4) AS mean, round(max(total), 4) AS most FROM steps JOIN g USING (route) GROUP BY signature, n""")
def section_stats(spark, d):
    """Each section of each route signature, over whole routes: number, least, mean and most."""
    s = V.steps(spark, d).groupBy("route").agg(F.array_sort(F.collect_list(F.struct("n", "flag", "total"))).alias("s"))
    each = s.select(F.array_join(F.transform("s", lambda x: x["flag"]), "-").alias("signature"), F.explode("s").alias("x"))
    return each.groupBy("signature", F.col("x.n").alias("section")).agg(F.count(F.lit(1)).alias("routes"), F.round(F.min("x.total"), 4).alias("least"), F.round(F.avg("x.total"), 4).alias("mean"), F.round(F.max("x.total"), 4).alias("most"))


@query("""WITH k AS (SELECT event_type AS path, user_id % 7 AS step, count(*) AS before, count(*) FILTER (value > 99.9 OR user_id % 7 < 3) AS after FROM events GROUP BY ALL) SELECT path, min(step) AS removed_at FROM k WHERE before > 0 AND after = 0 GROUP BY path""")
def benchmark_removal(spark, d):
    """The first step that drops every row on a benchmark's path."""
    kept = (F.col("value") > 99.9) | (F.col("user_id") % 7 < 3)
    k = V.read(spark, d, "events").groupBy(F.col("event_type").alias("path"), (F.col("user_id") % 7).alias("step")).agg(F.count(F.when(kept, 1)).alias("after"))
    return k.filter("after = 0").groupBy("path").agg(F.min("step").alias("removed_at"))


@query("""WITH w AS (SELECT s_nationkey AS nationkey, sum(CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal END) AS q, sum(CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal * s_suppkey END) AS qx, sum(CASE WHEN s_suppkey % 4 = 1 THEN 2.0 * s_suppkey END) AS ax, sum(CASE WHEN s_suppkey % 4 = 1 THEN 2.0 END) AS a FROM supplier GROUP BY s_nationkey)
SELECT nationkey, round(CASE WHEN q > 0 THEN qx / q WHEN a > 0 THEN ax / a ELSE 'inf'::DOUBLE END, 6) AS mean FROM w""")
def weighted_mean_fallbacks(spark, d):
    """Weighted by quantity, else by area, else infinite."""
    s, x, at = V.read(spark, d, "supplier"), F.col("s_suppkey"), F.col("s_suppkey") % 4
    w = s.groupBy(F.col("s_nationkey").alias("nationkey")).agg(
        F.sum(F.when(at == 0, F.col("s_acctbal"))).alias("q"), F.sum(F.when(at == 0, F.col("s_acctbal") * x)).alias("qx"), F.sum(F.when(at == 1, 2.0 * x)).alias("ax"), F.sum(F.when(at == 1, F.lit(2.0))).alias("a")
    )
    return w.select("nationkey", F.round(F.when(F.col("q") > 0, F.col("qx") / F.col("q")).when(F.col("a") > 0, F.col("ax") / F.col("a")).otherwise(C.INF), 6).alias("mean"))
