"""Networks from lines, gaps, shared stretches and nearest polygons. Customers' keys give the lines."""

from pyspark.sql import functions as F

from haulgraph.functions.geo import pad_extent
from haulgraph.operators.polygons import nearest_polygon
from haulgraph.operators.spatial import in_polygons
from haulgraph.plans import lines as L
from haulgraph.plans.cells import signed_area, union, voronoi
from haulgraph.plans.graphs import Written
from haulgraph.sources import network_view as V

from .registry import haversine, lat, lon, query, views

EVERY_M, SNAP_M, GAP_M, LIMIT_M = 50_000.0, 40_000.0, 600_000.0, 400_000.0


def _lines(spark, d):
    """A line of three points from each customer's place."""
    at = lambda x, y: F.struct(F.when(F.col("lon") + x > 180, F.col("lon") + x - 360).otherwise(F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat"))
    return V.starts(spark, d).select(F.col("start_id").alias("line_id"), F.array(at(0.0, 0.0), at(0.5, 0.25), at(1.0, -0.25)).alias("points"))


_ARC = "(12742000::DOUBLE * asin(sqrt(least(pow(sin(radians(({2}) - ({0})) / 2), 2.0::DOUBLE) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians(({3}) - ({1})) / 2), 2.0::DOUBLE), 1::DOUBLE))))"
_W = "(CASE WHEN {0} BETWEEN -180 AND 180 THEN {0} ELSE {0} + 180 - 360 * floor(({0} + 180) / 360) - 180 END)"
_CUT = f"""{views('starts')}, sides AS (SELECT start_id AS line_id, i, CASE WHEN lon + x1 > 180 THEN lon + x1 - 360 ELSE lon + x1 END AS lon1, lat + y1 AS lat1, CASE WHEN lon + x2 > 180 THEN lon + x2 - 360 ELSE lon + x2 END AS lon2, lat + y2 AS lat2
  FROM starts, (VALUES (1, 0.0::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE, 0.25::DOUBLE), (2, 0.5::DOUBLE, 0.25::DOUBLE, 1.0::DOUBLE, -0.25::DOUBLE)) v(i, x1, y1, x2, y2)),
lens AS (SELECT *, {_ARC.format("lat1", "lon1", "lat2", "lon2")} AS len FROM sides),
runs AS (SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY i) AS stop, coalesce(sum(len) OVER (PARTITION BY line_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM lens),
cuts AS (SELECT *, k * {EVERY_M} AS pos, (k * {EVERY_M} - begin) / len AS share FROM (SELECT *, unnest(range(floor(begin / {EVERY_M})::BIGINT + 1, floor(stop / {EVERY_M})::BIGINT + 1)) AS k FROM runs)),
marks AS (SELECT line_id, floor(begin / {EVERY_M})::BIGINT AS piece, begin AS pos, lon1 AS lon, lat1 AS lat FROM runs UNION SELECT line_id, floor(stop / {EVERY_M})::BIGINT, stop, lon2, lat2 FROM runs
  UNION SELECT line_id, k - o, pos, {_W.format("(lon1 + share * " + _W.format("(lon2 - lon1)") + ")")}, lat1 + share * (lat2 - lat1) FROM cuts, range(2) t(o)),
parts AS (SELECT line_id, piece, max(pos) - min(pos) AS length_m, arg_min(lon, pos) AS a_lon, arg_min(lat, pos) AS a_lat, arg_max(lon, pos) AS b_lon, arg_max(lat, pos) AS b_lat, count(*) AS points FROM marks GROUP BY line_id, piece HAVING max(pos) > min(pos))"""


@query(f"{_CUT} SELECT line_id, piece, round(length_m, 3) AS length_m, round(a_lon, 6) AS a_lon, round(a_lat, 6) AS a_lat, round(b_lon, 6) AS b_lon, round(b_lat, 6) AS b_lat, points FROM parts")
def line_pieces(spark, d):
    """Lines cut every 50 km."""
    p = L.pieces(_lines(spark, d), EVERY_M)
    end = lambda k, c: F.round(F.element_at("points", k)[c], 6)
    return p.select("line_id", "piece", F.round("length_m", 3).alias("length_m"), end(1, "lon").alias("a_lon"), end(1, "lat").alias("a_lat"), end(-1, "lon").alias("b_lon"), end(-1, "lat").alias("b_lat"), F.size("points").cast("long").alias("points"))


@query(f"""{_CUT}, e0 AS (SELECT round(a_lon, 10) AS lon, round(a_lat, 10) AS lat FROM parts UNION SELECT round(b_lon, 10), round(b_lat, 10) FROM parts),
ends AS MATERIALIZED (SELECT row_number() OVER (ORDER BY lat, lon) AS id, * FROM e0),
near AS (SELECT a.id AS x, b.id AS y FROM ends a JOIN ends b ON a.id <> b.id AND abs(a.lat - b.lat) < 0.5 WHERE {haversine("a.lat", "a.lon", "b.lat", "b.lon")} <= {SNAP_M}),
s(id, root) USING KEY (id) AS (SELECT id, id FROM ends UNION SELECT n.y, min(s.root) FROM s JOIN near n ON n.x = s.id LEFT JOIN recurring.s k ON k.id = n.y WHERE s.root < k.root GROUP BY n.y),
ids AS (SELECT DISTINCT p.line_id, p.piece, p.length_m, sa.root AS a, sb.root AS b FROM parts p JOIN ends ea ON ea.lon = round(a_lon, 10) AND ea.lat = round(a_lat, 10) JOIN ends eb ON eb.lon = round(b_lon, 10) AND eb.lat = round(b_lat, 10) JOIN s sa ON sa.id = ea.id JOIN s sb ON sb.id = eb.id WHERE sa.root <> sb.root),
edges_ AS (SELECT least(a, b) AS x, greatest(a, b) AS y, min(length_m) AS m FROM ids GROUP BY 1, 2),
g(id, root) USING KEY (id) AS (SELECT x, x FROM edges_ UNION SELECT y, y FROM edges_ UNION SELECT n.y, min(g.root) FROM g JOIN (SELECT x, y FROM edges_ UNION ALL SELECT y, x FROM edges_) n ON n.x = g.id LEFT JOIN recurring.g k ON k.id = n.y WHERE g.root < k.root GROUP BY n.y),
t AS (SELECT root, count(*) AS nodes FROM g GROUP BY root), m AS (SELECT g.root, count(*) AS edges, sum(m) AS length_m FROM edges_ e JOIN g ON g.id = e.x GROUP BY g.root)
SELECT nodes, edges, round(length_m, 2) AS length_m, count(*) AS graphs FROM t JOIN m USING (root) GROUP BY 1, 2, 3""")
def line_network(spark, d):
    """The pieces as a network, ends within 40 km joined: graphs by their nodes, edges and length."""
    nodes, edges = L.network(L.pieces(_lines(spark, d), EVERY_M), SNAP_M, Written(spark))
    size = edges.groupBy("graph").agg(F.count(F.lit(1)).alias("edges"), F.sum("distance_m").alias("length_m"))
    return nodes.groupBy("graph").agg(F.count(F.lit(1)).alias("nodes")).join(size, "graph").groupBy("nodes", "edges", F.round("length_m", 2).alias("length_m")).agg(F.count(F.lit(1)).alias("graphs"))


@query(f"""{views('starts')}, e AS (SELECT start_id * 2 + o AS id, start_id AS graph, lat + o * -0.25::DOUBLE AS lat, CASE WHEN lon + o > 180 THEN lon + o - 360 ELSE lon + o END AS lon FROM starts, range(2) t(o)),
p AS (SELECT a.id AS a, b.id AS b, a.graph AS g, b.graph AS h, {haversine("a.lat", "a.lon", "b.lat", "b.lon")} AS distance_m FROM e a JOIN e b ON a.id < b.id AND a.graph <> b.graph AND abs(a.lat - b.lat) < 6),
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY distance_m, a, b) AS k, * FROM p WHERE distance_m <= {GAP_M}), last AS (SELECT max(start_id) AS n FROM starts),
f(k, groups, a, b, distance_m) AS (SELECT 0::BIGINT, range(n + 1), NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM last
 UNION ALL SELECT f.k + 1, CASE WHEN groups[c.g + 1] <> groups[c.h + 1] THEN list_transform(groups, lambda x: CASE WHEN x = groups[c.h + 1] THEN groups[c.g + 1] ELSE x END) ELSE groups END,
  CASE WHEN groups[c.g + 1] <> groups[c.h + 1] THEN c.a END, c.b, c.distance_m FROM f JOIN c ON c.k = f.k + 1)
SELECT a, b, distance_m FROM f WHERE a IS NOT NULL""")
def gap_closing(spark, d):
    """The least lines up to 600 km that join the customers' lines at their ends."""
    s = V.starts(spark, d).withColumn("o", F.explode(F.array(F.lit(0), F.lit(1))))
    east = F.col("lon") + F.col("o")
    ends = s.select((F.col("start_id") * 2 + F.col("o")).alias("id"), F.col("start_id").alias("graph"), (F.col("lat") + F.col("o") * -0.25).alias("lat"), F.when(east > 180, east - 360).otherwise(east).alias("lon"))
    return L.close_gaps(ends, GAP_M, Written(spark))


@query("""WITH i AS (SELECT l_suppkey AS k, l_partkey % 500 AS a, l_partkey % 500 + l_quantity::BIGINT % 6 AS b FROM lineitem), v AS (SELECT * FROM i WHERE a < b),
e AS (SELECT k, pos, sum(s) AS s FROM (SELECT k, a AS pos, 1 AS s FROM v UNION ALL SELECT k, b, -1 FROM v) GROUP BY k, pos),
r AS (SELECT k, pos AS a, lead(pos) OVER w AS b, sum(s) OVER w AS routes FROM e WINDOW w AS (PARTITION BY k ORDER BY pos)) SELECT k, a, b, routes::BIGINT AS routes FROM r WHERE routes > 0""")
def overlap_split(spark, d):
    """Stretches of a line between the ends of the routes over it, with their number."""
    li = V.read(spark, d, "lineitem")
    a = F.col("l_partkey") % 500
    return L.shared_stretches(li.select(F.col("l_suppkey").alias("k"), a.alias("a"), (a + F.col("l_quantity").cast("long") % 6).alias("b")), Written(spark))


_V = "[cos(radians({0})) * cos(radians({1})), cos(radians({0})) * sin(radians({1})), sin(radians({0}))]"
_X = "[{0}[2] * {1}[3] - {0}[3] * {1}[2], {0}[3] * {1}[1] - {0}[1] * {1}[3], {0}[1] * {1}[2] - {0}[2] * {1}[1]]"
_D = "({0}[1] * {1}[1] + {0}[2] * {1}[2] + {0}[3] * {1}[3])"


@query(f"""{views('starts')}, boxes AS (SELECT n_nationkey AS land, -50.0::DOUBLE + (n_nationkey % 5) * 22 AS south, -175.0::DOUBLE + floor(n_nationkey / 5) * 70 AS west FROM nation),
side AS (SELECT land, south + y1 AS lat1, west + x1 AS lon1, south + y2 AS lat2, west + x2 AS lon2 FROM boxes, (VALUES (0, 0, 30, 0), (30, 0, 30, 12), (30, 12, 0, 12), (0, 12, 0, 0)) v(x1, y1, x2, y2)),
u AS (SELECT *, {_V.format("lat1", "lon1")} AS a, {_V.format("lat2", "lon2")} AS b FROM side), w AS (SELECT *, {_X.format("a", "b")} AS n FROM u),
z AS (SELECT *, {_X.format("n", "a")} AS na, {_X.format("b", "n")} AS bn, sqrt({_D.format("n", "n")}) AS size FROM w), q AS (SELECT start_id, lat, lon, {_V.format("lat", "lon")} AS p FROM starts),
dist AS (SELECT start_id, land, CASE WHEN {_D.format("na", "p")} >= 0 AND {_D.format("bn", "p")} >= 0 THEN asin(least(abs({_D.format("n", "p")}) / size, 1)) * 6371000 ELSE least({_ARC.format("lat", "lon", "lat1", "lon1")}, {_ARC.format("lat", "lon", "lat2", "lon2")}) END AS m FROM q, z),
every AS (SELECT start_id, land, m FROM dist WHERE m <= {LIMIT_M} UNION ALL SELECT start_id, land, 0 FROM starts JOIN boxes ON lat >= south AND lat < south + 12 AND lon >= west AND lon < west + 30)
SELECT start_id, arg_min(land, {{'m': m, 'l': land}}) AS land, round(min(m), 2) AS distance_m FROM every GROUP BY start_id""")
def nearest_land(spark, d):
    """Starts with the land they lie on, or the nearest within 400 km by its coast."""
    points = V.starts(spark, d).select(F.col("start_id").alias("id"), "lat", "lon")
    return nearest_polygon(points, _lands(spark, d), "land", LIMIT_M).select(F.col("id").alias("start_id"), "land", F.round("distance_m", 2).alias("distance_m"))


_LAND = "boxes AS (SELECT n_nationkey AS land, -50.0::DOUBLE + (n_nationkey % 5) * 22 AS south, -175.0::DOUBLE + floor(n_nationkey / 5) * 70 AS west FROM nation)"


def _lands(spark, d):
    n = V.read(spark, d, "nation").select(F.col("n_nationkey").alias("land"), (F.lit(-50.0) + (F.col("n_nationkey") % 5) * 22).alias("south"), (F.lit(-175.0) + F.floor(F.col("n_nationkey") / 5) * 70).alias("west"))
    at = lambda x, y: F.struct((F.col("west") + x).alias("lon"), (F.col("south") + y).alias("lat"))
    return n.select("land", F.array(at(0, 0), at(30, 0), at(30, 12), at(0, 12), at(0, 0)).alias("ring"))


@query(f"""{views('starts')}, {_LAND}, s AS (SELECT start_id AS site, land, lon, lat FROM starts JOIN boxes ON lat >= south AND lat < south + 12 AND lon >= west AND lon < west + 30),
p AS (SELECT p_partkey AS point, land, x, y FROM (SELECT p_partkey, {lon("p_partkey")} + 0.00317 AS x, {lat("p_partkey")} + 0.00713 AS y FROM part) JOIN boxes ON y >= south AND y < south + 12 AND x >= west AND x < west + 30)
SELECT point, arg_min(site, {{'d': (x - lon) * (x - lon) + (y - lat) * (y - lat), 's': site}}) AS site FROM p JOIN s USING (land) GROUP BY point""")
def voronoi_cells(spark, d):
    """Which customer's cell of its land a part's place lies in: the nearest customer's."""
    land = _lands(spark, d)
    inside = in_polygons(V.starts(spark, d).select(F.col("start_id").alias("id"), "lat", "lon"), land, 6.0).select(F.col("id").alias("site"), "land")
    sites = inside.join(V.starts(spark, d).select(F.col("start_id").alias("site"), "lat", "lon"), "site")
    keep = Written(spark)
    cells = keep.cut(voronoi(sites, land, keep))
    key = F.col("p_partkey")
    points = V.read(spark, d, "part").select(key.alias("id"), (V.lat_of(key) + 0.00713).alias("lat"), (V.lon_of(key) + 0.00317).alias("lon"))
    # squares as wide as a cell is on average, so that a point meets a few cells however many there are
    frame = lambda c: F.array_max(F.transform("ring", lambda p: p[c])) - F.array_min(F.transform("ring", lambda p: p[c]))
    width = cells.agg(F.avg(F.greatest(frame("lon"), frame("lat")))).first()[0] or 6.0
    return in_polygons(points, cells.select("site", "ring"), min(max(width, 1e-3), 6.0)).select(F.col("id").alias("point"), "site")


@query(f"""{views('starts')}, cell AS (SELECT DISTINCT nationkey AS land, floor(lon / 30)::BIGINT AS x, floor((lat + 60) / 24)::BIGINT AS y FROM starts),
side AS (SELECT land, x, y, x + 1 AS x2, y AS y2 FROM cell UNION ALL SELECT land, x, y + 1, x + 1, y + 1 FROM cell UNION ALL SELECT land, x, y, x, y + 1 FROM cell UNION ALL SELECT land, x + 1, y, x + 1, y + 1 FROM cell),
o AS (SELECT land, count(*) AS sides FROM (SELECT land, x, y, x2, y2 FROM side GROUP BY ALL HAVING count(*) = 1) GROUP BY land), a AS (SELECT land, count(*) * 30 * 24 AS area FROM cell GROUP BY land)
SELECT a.land, sides::BIGINT AS sides, area::DOUBLE AS area FROM a JOIN o USING (land)""")
def region_union(spark, d):
    """Outlines of the unions of grid squares in which a country has customers: their sides and area."""
    cell = V.starts(spark, d).select(F.col("nationkey").alias("land"), F.floor(F.col("lon") / 30).alias("x"), F.floor((F.col("lat") + 60) / 24).alias("y")).distinct()
    at = lambda i, j: F.struct(((F.col("x") + i) * 30.0).alias("lon"), ((F.col("y") + j) * 24.0 - 60.0).alias("lat"))
    rings = union(cell.select("land", F.array(at(0, 0), at(0, 1), at(1, 1), at(1, 0), at(0, 0)).alias("ring")), Written(spark))
    return rings.groupBy("land").agg(F.sum(F.size("ring") - 1).cast("long").alias("sides"), F.round(F.sum(signed_area(F.col("ring"))), 6).alias("area"))


@query(f"""{views("starts")}, e AS (SELECT nationkey, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM starts GROUP BY nationkey)
SELECT nationkey, round(greatest(s - greatest((n - s) * 0.03::DOUBLE, 1), -90), 6) AS south, round(least(n + greatest((n - s) * 0.03::DOUBLE, 1), 90), 6) AS north,
 round(w - greatest((e - w) * 0.03::DOUBLE, 1), 6) AS west, round(e + greatest((e - w) * 0.03::DOUBLE, 1), 6) AS east FROM e""")
def padded_extent(spark, d):
    """The box of each country's start locations, wider by three hundredths and a degree at least, no further than the poles."""
    e = V.starts(spark, d).groupBy("nationkey").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    (south, north), (west, east) = pad_extent(F.col("s"), F.col("n")), pad_extent(F.col("w"), F.col("e"))
    sides = {"south": F.greatest(south, F.lit(-90.0)), "north": F.least(north, F.lit(90.0)), "west": west, "east": east}
    return e.select("nationkey", *(F.round(c, 6).alias(k) for k, c in sides.items()))
