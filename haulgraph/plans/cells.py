"""Areas: Voronoi cells of sites clipped to their land, and unions of regions that share sides. Coordinates are planar."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import Written

POINT = "struct<lon: double, lat: double>"


def signed_area(ring: Column) -> Column:
    """Twice-summed cross products halved: positive if a closed ring of (lon, lat) runs counter-clockwise."""
    turn = lambda t, i: t + F.element_at(ring, i)["lon"] * F.element_at(ring, i + 1)["lat"] - F.element_at(ring, i + 1)["lon"] * F.element_at(ring, i)["lat"]
    return F.when(F.size(ring) > 3, F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), turn) / 2).otherwise(F.lit(0.0))


def _clip(ring: Column, x: Column, y: Column, u: Column, v: Column) -> Column:
    """The part of an open ring that is nearer to (x, y) than to (u, v): each side keeps its near end and where it crosses over."""
    # positive on the near side of the line half-way between the two
    side = lambda p: (p["lon"] - (x + u) / 2) * (x - u) + (p["lat"] - (y + v) / 2) * (y - v)
    point = lambda a, b: F.struct(a.alias("lon"), b.alias("lat"))

    def step(p: Column, i: Column) -> Column:
        q = F.element_at(ring, i % F.size(ring) + 1)
        a, b = side(p), side(q)
        t = a / (a - b)
        crossing = point(p["lon"] + t * (q["lon"] - p["lon"]), p["lat"] + t * (q["lat"] - p["lat"]))
        own = F.when(a >= 0, F.array(point(p["lon"], p["lat"]))).otherwise(F.expr(f"cast(array() as array<{POINT}>)"))
        return F.concat(own, F.when((a > 0) != (b > 0), F.when((a != 0) & (b != 0), F.array(crossing)).otherwise(F.expr(f"cast(array() as array<{POINT}>)"))).otherwise(F.expr(f"cast(array() as array<{POINT}>)")))

    numbered = F.transform(ring, lambda p, i: F.struct(p.alias("p"), (i + 1).alias("i")))
    return F.flatten(F.transform(numbered, lambda n: step(n["p"], n["i"])))


def voronoi(sites: DataFrame, lands: DataFrame, keep: Written, reach: float | None = None) -> DataFrame:
    """(site, land, ring): of each land (land, ring: closed) the part nearest to each of its sites (site, land, lon, lat).

    A cell is the land's ring clipped by the half-planes towards the site's neighbours, nearest first. Neighbours come by a
    grid join within ``reach``; no site beyond twice the distance to the cell's farthest corner can cut it, so a cell within
    that is done, and the others go on with twice the reach, which begins where sites of the densest land have a few dozen
    neighbours. Of sites at one place the least has the cell; a land
    with one site is its cell, a land without has none. Rings are closed; parts of a land that is not convex may be
    joined by sides without area.
    """
    own = keep.cut(sites.groupBy("land", "lon", "lat").agg(F.min("site").alias("site")).join(lands.select("land", F.slice("ring", 1, F.size("ring") - 1).alias("ring")), "land"))
    out, left = [], own
    if reach is None:
        frame = lambda c: F.array_max(F.transform("ring", lambda p: p[c])) - F.array_min(F.transform("ring", lambda p: p[c]))
        room = lands.select("land", (frame("lon") * frame("lat")).alias("room")).join(own.groupBy("land").count(), "land").agg(F.min(F.col("room") / F.col("count"))).first()[0]
        reach = max(3 * math.sqrt(room or 0.0), 1e-6)
    widest = lands.select(F.max(F.array_max(F.transform("ring", lambda p: p["lon"])) - F.array_min(F.transform("ring", lambda p: p["lon"])) + F.array_max(F.transform("ring", lambda p: p["lat"])) - F.array_min(F.transform("ring", lambda p: p["lat"])))).first()[0]
    while True:
        every = widest is None or reach > 2 * widest  # then a neighbour is any other site of the land
        at = lambda c: F.floor(F.col(c) / reach)  # noqa: B023, E731
        around = F.array(F.lit(-1), F.lit(0), F.lit(1))
        spread = own.select("land", F.col("lon").alias("u"), F.col("lat").alias("v"), at("lon").alias("gx"), at("lat").alias("gy"))
        spread = spread.withColumn("gx", F.explode(F.transform(around, lambda s: F.col("gx") + s))).withColumn("gy", F.explode(F.transform(around, lambda s: F.col("gy") + s)))
        far = F.pow(F.col("lon") - F.col("u"), F.lit(2)) + F.pow(F.col("lat") - F.col("v"), F.lit(2))
        met = left.withColumn("gx", at("lon")).withColumn("gy", at("lat")).join(spread, ["land", "gx", "gy"]).withColumn("far", far).filter((F.col("far") > 0) & (F.col("far") <= reach * reach))
        near = met.groupBy("land", "site").agg(F.array_sort(F.collect_list(F.struct("far", "u", "v"))).alias("near"))
        ring = F.aggregate(F.coalesce("near", F.expr("cast(array() as array<struct<far: double, u: double, v: double>>)")), F.col("ring"), lambda r, n: _clip(r, F.col("lon"), F.col("lat"), n["u"], n["v"]))
        corner = F.array_max(F.transform("cell", lambda p: F.pow(p["lon"] - F.col("lon"), F.lit(2)) + F.pow(p["lat"] - F.col("lat"), F.lit(2))))
        cut = keep.cut(left.join(near, ["land", "site"], "left").withColumn("cell", ring).withColumn("done", F.lit(every) | (4 * F.coalesce(corner, F.lit(0.0)) <= reach * reach)).drop("near"))
        out.append(cut.filter("done"))
        left = cut.filter("not done").drop("cell", "done")
        if every or left.isEmpty():
            break
        reach *= 2
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    return whole.filter(F.size("cell") > 2).select("site", "land", F.concat("cell", F.slice("cell", 1, 1)).alias("ring"))


def union(regions: DataFrame, keep: Written) -> DataFrame:
    """(land, part, ring): the outlines of regions (land, ring: closed) of one land that meet along whole sides.

    All rings are turned counter-clockwise; a side that another region has the other way round is inside and goes with it.
    What is left is chained into rings: a side points to the one that leaves from its end (of several the sharpest turn to
    the right, so parts that touch at a corner stay apart), and doubling the pointers gives each side its ring's least side
    and its place from there, in logarithmic rounds. Outer rings run counter-clockwise, holes clockwise; parts are
    numbered by their least side.
    """
    ring = F.when(signed_area(F.col("ring")) < 0, F.reverse("ring")).otherwise(F.col("ring"))
    pair = F.transform(F.when(F.size("r") > 3, F.sequence(F.lit(1), F.size("r") - 1)), lambda i: F.struct(F.element_at("r", i).alias("p"), F.element_at("r", i + 1).alias("q")))
    sides = regions.select("land", ring.alias("r")).select("land", F.explode(pair).alias("s")).select("land", F.struct("s.p.lon", "s.p.lat").alias("p"), F.struct("s.q.lon", "s.q.lat").alias("q")).filter("p <> q").distinct()
    back = sides.select("land", F.col("p").alias("q"), F.col("q").alias("p"))
    outer = keep.cut(sides.join(back, ["land", "p", "q"], "left_anti"))
    name = F.struct("p", "q")
    ahead = outer.select("land", F.col("p").alias("q"), F.col("q").alias("z"))
    turn = F.atan2((F.col("q.lon") - F.col("p.lon")) * (F.col("z.lat") - F.col("q.lat")) - (F.col("q.lat") - F.col("p.lat")) * (F.col("z.lon") - F.col("q.lon")), (F.col("q.lon") - F.col("p.lon")) * (F.col("z.lon") - F.col("q.lon")) + (F.col("q.lat") - F.col("p.lat")) * (F.col("z.lat") - F.col("q.lat")))
    following = outer.join(ahead, ["land", "q"]).groupBy("land", name.alias("e")).agg(F.max(F.struct(turn.alias("t"), F.struct("q", "z").alias("n"))).alias("m"))
    link = keep.cut(following.select("land", "e", F.struct(F.col("m.n.q").alias("p"), F.col("m.n.z").alias("q")).alias("next")))

    # the least side of each ring: the minimum over twice as many sides each round; sides are distinct, so it ends once nothing falls
    jump = link.select("land", "e", "next", F.least("e", "next").alias("least"))
    while True:
        to = jump.select("land", F.col("e").alias("next"), F.col("next").alias("n2"), F.col("least").alias("l2"))
        new = keep.cut(jump.join(to, ["land", "next"]).select("land", "e", F.col("n2").alias("next"), F.least("least", "l2").alias("least"), (F.col("l2") < F.col("least")).alias("fell")))
        jump = new.drop("fell")
        if new.filter("fell").isEmpty():
            break
    ring_of = jump.select("land", "e", F.col("least").alias("ring"))
    # places: distance back to the least side, the pointers doubled until all have reached it
    before = link.select("land", F.col("next").alias("e"), F.col("e").alias("prev")).join(ring_of, ["land", "e"])
    at_start = F.col("e") == F.col("ring")
    walk = keep.cut(before.select("land", "e", "ring", F.when(at_start, F.col("e")).otherwise(F.col("prev")).alias("prev"), F.when(at_start, 0).otherwise(1).alias("place")))
    while not walk.filter("prev <> ring").isEmpty():
        to = walk.select("land", F.col("e").alias("prev"), F.col("prev").alias("p2"), F.col("place").alias("more"))
        walk = keep.cut(walk.join(to, ["land", "prev"]).select("land", "e", "ring", F.col("p2").alias("prev"), (F.col("place") + F.col("more")).alias("place")))
    rings = walk.groupBy("land", "ring").agg(F.array_sort(F.collect_list(F.struct("place", "e.p"))).alias("s"))
    points = F.transform("s", lambda x: x["p"])
    numbered = rings.select("land", "ring", F.concat(points, F.slice(points, 1, 1)).alias("points"))
    parts = numbered.groupBy("land").agg(F.array_sort(F.collect_list("ring")).alias("all")).select("land", "all")
    return numbered.join(parts, "land").select("land", F.array_position("all", F.col("ring")).cast("int").alias("part"), F.col("points").alias("ring"))
