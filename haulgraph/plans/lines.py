"""Networks from lines: pieces of equal length, joined ends, closed gaps, and stretches that several lines share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulgraph.functions.geo import arc_m, haversine_m, wrap
from haulgraph.operators import spatial as X
from haulgraph.operators.prefix import running_sums

from .graphs import Written, components

SPHERE_M2 = 4 * math.pi * 6371000.0**2
POINTS = "array<struct<lon: double, lat: double>>"


def points_of(wkt: Column) -> Column:
    """The points of a LINESTRING text as an array of (lon, lat); null for anything else."""
    body = F.regexp_extract(wkt, r"(?i)^\s*linestring\s*(?:z\s*)?\(([^()]*)\)\s*$", 1)
    pair = lambda t: F.split(F.trim(t), r"\s+")
    return F.when(body != "", F.transform(F.split(body, ","), lambda t: F.struct(pair(t)[0].cast("double").alias("lon"), pair(t)[1].cast("double").alias("lat"))))


def wkt_of(points: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["lon"], p["lat"])), ", "), F.lit(")"))


def pieces(lines: DataFrame, every_m: float = 50_000.0) -> DataFrame:
    """(line_id, piece, points, length_m): each line (line_id, points) cut every ``every_m`` from its beginning.

    Positions are running great-circle lengths; a cut lies between two points in proportion, by the shorter way over the
    date line, and ends one piece and begins the next. Lines of fewer than two points, or of no length, have no pieces.
    """
    numbers = F.when(F.size("points") > 1, F.sequence(F.lit(1), F.size("points") - 1))
    pair = F.transform(numbers, lambda i: F.struct(i.alias("i"), F.element_at("points", i).alias("p"), F.element_at("points", i + 1).alias("q")))
    sides = lines.select("line_id", F.explode(pair).alias("s")).select("line_id", "s.*")
    sides = sides.withColumn("len", arc_m(F.col("p.lat"), F.col("p.lon"), F.col("q.lat"), F.col("q.lon")))
    run = Window.partitionBy("line_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = sides.withColumn("to", F.sum("len").over(run)).withColumn("from", F.coalesce(F.lag("to").over(Window.partitionBy("line_id").orderBy("i")), F.lit(0.0)))
    first, last = F.floor(F.col("from") / every_m) + 1, F.floor(F.col("to") / every_m)
    cuts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    share = lambda k: (k * every_m - F.col("from")) / F.col("len")
    cut = lambda k: F.struct((k * every_m).alias("at"), wrap(F.col("p.lon") + share(k) * wrap(F.col("q.lon") - F.col("p.lon"))).alias("lon"), (F.col("p.lat") + share(k) * (F.col("q.lat") - F.col("p.lat"))).alias("lat"))
    at = lambda end, point: F.struct(F.col(end).alias("at"), F.col(f"{point}.lon").alias("lon"), F.col(f"{point}.lat").alias("lat"))
    whole = lambda x: F.floor(x / every_m)
    inner = F.filter(F.array(at("from", "p"), at("to", "q")), lambda e: (e["at"] == 0) | (whole(e["at"]) * every_m != e["at"]))
    placed = F.concat(F.transform(inner, lambda e: F.struct(whole(e["at"]).alias("piece"), e.alias("e"))), F.flatten(F.transform(cuts, lambda k: F.array(F.struct((k - 1).alias("piece"), cut(k).alias("e")), F.struct(k.alias("piece"), cut(k).alias("e"))))))
    marks = sides.select("line_id", F.explode(placed).alias("m")).select("line_id", "m.piece", "m.e")
    held = marks.groupBy("line_id", "piece").agg(F.array_sort(F.collect_set("e")).alias("e"))
    length = F.element_at("e", -1)["at"] - F.col("e")[0]["at"]
    return held.withColumn("length_m", length).filter("length_m > 0").select("line_id", "piece", F.transform("e", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("points"), "length_m")


def tied(ends: DataFrame, snap_m: float, keep: Written) -> DataFrame:
    """(end, node): for each of ``ends`` (end, lat, lon) the least end that steps of at most ``snap_m`` lead to.

    Ends of one square whose diagonal is shorter than a step are tied, so its least end stands for it, and ends that stand
    for squares tie these if they are within a step. Only squares near one another that are still apart compare all their
    ends; where ends are dense there are few, so the work does not grow with the pairs.
    """
    side = lambda df, s: df.select(F.col("end").alias(f"{s}_id"), F.col("lat").alias(f"{s}_lat"), F.col("lon").alias(f"{s}_lon"))
    if snap_m < 1000:  # distances are rounded up to metres, which squares this small would have to allow for
        near = X.within_distance(side(ends, "l"), side(ends, "r"), snap_m).filter("l_id < r_id").select(F.col("l_id").alias("src"), F.col("r_id").alias("dst"))
        return ends.select("end").join(components(near).withColumnRenamed("node", "end"), "end", "left").select("end", F.coalesce("root", "end").alias("node"))
    high = 0.7 * snap_m / 111_300.0
    band = F.floor((F.col("lat") + 90) / high)
    # a square is as wide as it is high at the edge of its band nearer the equator
    edge = F.when(F.col("band") * high - 90 > 0, F.col("band") * high - 90).when((F.col("band") + 1) * high - 90 < 0, 90 - (F.col("band") + 1) * high).otherwise(F.lit(0.0))
    count = F.ceil(360 * F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(1e-6)) / high)
    placed = keep.cut(ends.select("end", "lat", "lon", band.alias("band")).withColumn("column", F.least(F.floor((F.col("lon") + 180) / 360 * count), count - 1)))
    least = keep.cut(placed.groupBy("band", "column").agg(F.min(F.struct("end", "lat", "lon")).alias("m")).select("band", "column", "m.*"))
    sure = keep.cut(X.within_distance(side(least, "l"), side(least, "r"), snap_m).filter("l_id < r_id").select(F.col("l_id").alias("src"), F.col("r_id").alias("dst")))
    root = keep.cut(least.join(components(sure).withColumnRenamed("node", "end"), "end", "left").withColumn("root", F.coalesce("root", "end")))
    named = lambda s: side(root, s).join(root.select(F.col("end").alias(f"{s}_id"), F.col("root").alias(f"{s}_root")), f"{s}_id")
    apart = keep.cut(X.within_distance(named("l"), named("r"), 3 * snap_m).filter("l_id < r_id and l_root <> r_root").select("l_id", "r_id", "l_root", "r_root"))
    held = keep.cut(placed.join(least.select("band", "column", F.col("end").alias("square")), ["band", "column"]))
    of = lambda s: held.select(F.col("square").alias(f"{s}_id"), F.col("lat").alias(f"{s}_lat"), F.col("lon").alias(f"{s}_lon"))
    far = haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))
    met = X.spread(apart.join(of("l"), "l_id"), "r_id").join(of("r"), "r_id").filter(far <= snap_m).select(F.col("l_root").alias("src"), F.col("r_root").alias("dst")).distinct()
    last = keep.cut(components(met).toDF("root", "node"))
    whole = root.join(last, "root", "left").select(F.col("end").alias("square"), F.coalesce("node", "root").alias("node"))
    return held.join(whole, "square").select("end", "node")


def network(parts: DataFrame, snap_m: float, keep: Written) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, lon, lat, graph) and edges (src, dst, graph, distance_m, points) of pieces (points, length_m).

    Ends within ``snap_m`` of one another, or of a third, are one node, named and placed by the least of them; equal ends
    (ten decimals) are one in any case. Of parallel edges the shortest stays, a piece from a node to itself goes. A graph is
    what edges join, named by its least node.
    """
    end = lambda k: F.element_at("points", k)
    name = lambda p: F.concat_ws(" ", F.round(p["lon"], 10), F.round(p["lat"], 10))
    held = keep.cut(parts.select("points", "length_m", name(end(1)).alias("a"), name(end(-1)).alias("b")))
    ends = held.select(F.col("a").alias("end"), end(1).alias("p")).unionByName(held.select(F.col("b").alias("end"), end(-1).alias("p"))).groupBy("end").agg(F.min("p").alias("p"))
    ends = keep.cut(ends.select("end", F.round("p.lon", 10).alias("lon"), F.round("p.lat", 10).alias("lat")))
    groups = keep.cut(tied(ends, snap_m, keep))
    to = lambda c, n: groups.select(F.col("end").alias(c), F.col("node").alias(n))
    moved = held.join(to("a", "src"), "a").join(to("b", "dst"), "b").filter("src <> dst")
    shortest = moved.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min(F.struct("length_m", "points")).alias("m"))
    edges = keep.cut(shortest.select("src", "dst", F.col("m.length_m").alias("distance_m"), "m.points"))
    graph = keep.cut(components(edges.select("src", "dst")))
    nodes = ends.join(graph.withColumnRenamed("node", "end"), "end").select(F.col("end").alias("node"), "lon", "lat", F.col("root").alias("graph"))
    return nodes, edges.join(graph.select(F.col("node").alias("src"), F.col("root").alias("graph")), "src")


def close_gaps(ends: DataFrame, gap_m: float, keep: Written) -> DataFrame:
    """(a, b, distance_m): the least lines, of at most ``gap_m`` each, that join all graphs of ``ends`` (id, graph, lat, lon) they can.

    Each graph takes its shortest line to another (equal ones: lesser ids); graphs that are joined become one, and so on until no
    line is left: a least spanning forest in logarithmic rounds. Of the lines between two graphs only the shortest goes on.
    Short lines come first: the reach begins where an end meets a few others and grows fourfold up to ``gap_m``. As all lines
    of a reach come before longer ones, the forest is the same; and each line of the next one has an end outside the
    largest group, so ends that are joined to it meet only those that are not.
    No table of ends or groups goes through the driver: joins are merges.
    """
    placed = keep.cut(ends.select("id", "graph", "lat", "lon", F.col("graph").alias("group")))
    steps = max(0, math.ceil(math.log(max(gap_m / math.sqrt(4 * SPHERE_M2 / (math.pi * max(placed.count(), 1))), 1.0), 4)))
    line = F.struct("distance_m", F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"))

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.filter("g <> h").groupBy(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).agg(F.min("line").alias("line"))

    out = []
    for k in range(steps, -1, -1):
        size = placed.groupBy("group").count().orderBy(F.desc("count"), "group").limit(2).collect()
        if len(size) < 2:
            break
        side = lambda df, s: df.select(F.col("id").alias(f"{s}_id"), F.col("lat").alias(f"{s}_lat"), F.col("lon").alias(f"{s}_lon"), F.col("group").alias(f"{s}_group"))
        most = F.lit(size[0]["group"])
        near = X.within_distance(side(placed.filter(F.col("group") != most), "l"), side(placed, "r"), gap_m / 4**k).filter((F.col("l_group") != F.col("r_group")) & ((F.col("l_id") < F.col("r_id")) | (F.col("r_group") == most)))
        live = keep.cut(least(near.select(F.col("l_group").alias("g"), F.col("r_group").alias("h"), line.alias("line"))))
        renamed = placed
        while not live.isEmpty():
            each = live.select(F.explode(F.array("g", "h")).alias("own"), F.struct("line", "g", "h").alias("x")).groupBy("own").agg(F.min("x").alias("x"))
            taken = keep.cut(each.select("x.*").distinct())
            out.append(taken.select("line.*"))
            roots = keep.cut(components(taken.select(F.col("g").alias("src"), F.col("h").alias("dst"))))
            to = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")).hint("merge")  # noqa: B023, E731
            live = keep.cut(least(live.join(to("g"), "g", "left").join(to("h"), "h", "left").select(F.coalesce("g_root", "g").alias("g"), F.coalesce("h_root", "h").alias("h"), "line")))
            renamed = keep.cut(renamed.join(to("group"), "group", "left").select("id", "graph", "lat", "lon", F.coalesce("group_root", "group").alias("group")))
        placed = renamed
    if not out:
        return ends.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("distance_m")).limit(0)
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every.select("a", "b", "distance_m")


def shared_stretches(intervals: DataFrame, keep: Written) -> DataFrame:
    """(k, a, b, routes): each line k's stretches between neighbouring ends of intervals (k, a, b) that some interval covers.

    Ends are signed and summed by place first; the running sum of the signs is the number of intervals over a stretch, so
    length times routes adds up to the intervals' lengths. Empty or reversed intervals cover nothing.
    """
    given = intervals.filter("a < b")
    ends = given.select("k", F.col("a").alias("at"), F.lit(1).alias("sign")).unionByName(given.select("k", F.col("b").alias("at"), F.lit(-1).alias("sign")))
    places = ends.groupBy("k", "at").agg(F.sum("sign").alias("sign"), F.lit(1).alias("one"))
    run = keep.cut(running_sums(places, ["k"], ["at"], {"routes": "sign", "place": "one"}, keep))
    after = run.select(F.col("k").alias("_k"), (F.col("place") - 1).alias("_place"), F.col("at").alias("b"))
    return run.filter("routes > 0").join(after, F.col("k").eqNullSafe(F.col("_k")) & (F.col("place") == F.col("_place"))).select("k", F.col("at").alias("a"), "b", F.col("routes").cast("long").alias("routes"))
