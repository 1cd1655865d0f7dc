"""Distance joins by grid cells: equal cells join first, exact distances decide."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulgraph.functions.geo import haversine_m, round_quarter
from haulgraph.operators import state as S

DEGREE_M = 111194.0


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into a fixed number of parts, as few bytes that make many pairs would be merged into one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def within_groups(left: DataFrame, right: DataFrame, on: str, l_id: str, r_id: str, block: int = 4096) -> DataFrame:
    """All pairs of rows that agree in ``on``, however few and large the groups.

    Left rows are dealt by their own id into as many parts as tasks; right rows come as lists of about ``block`` ids of a group, and
    each part gets every list, so a task holds one part and one list at a time and no group is one task's work.
    """
    parts = 4 * left.sparkSession.sparkContext.defaultParallelism
    dealt = left.select(F.col(l_id), F.col(on), F.pmod(F.xxhash64(l_id), F.lit(parts)).alias("_part"))
    size = right.groupBy(on).agg(F.ceil(F.count(F.lit(1)) / block).alias("_lists"))
    lists = right.join(size.hint("broadcast"), on).groupBy(on, F.pmod(F.xxhash64(r_id), F.col("_lists")).alias("_list")).agg(F.collect_list(r_id).alias("_ids"))
    lists = lists.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    keys = [on, "_part"]
    met = spread(dealt, *keys).join(spread(lists, *keys).hint("merge"), keys)
    return met.select(l_id, on, F.explode("_ids").alias(r_id))


def within_distance(left: DataFrame, right: DataFrame, limit_m: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of (l_id, l_lat, l_lon, ...) and (r_id, r_lat, r_lon, ...) within ``limit_m``, with distance_m.

    Rows fall into bands of latitude as high as the limit, and in each band into cells of longitude wide enough for it at
    the band's edge nearer the pole; a right row is also put in the neighbouring cells, across +-180 degrees too. Rows of
    a pair agree in the columns ``on``. Sizes before a row is multiplied mislead Spark, so neither side is sent whole.
    """
    height = max(limit_m / DEGREE_M * 1.001, 0.01)

    def band(lat):
        return F.floor((lat + 90.0) / height).cast("int")

    def cells(band_of):
        edge = F.greatest(F.abs(band_of * height - 90.0), F.abs((band_of + 1) * height - 90.0)) + height
        width = F.when(edge >= 89.0, F.lit(360.0)).otherwise(F.least(F.lit(height) / F.cos(F.radians(edge)), F.lit(360.0)))
        return F.greatest(F.floor(F.lit(360.0) / width), F.lit(1)).cast("int")

    def cell(lon, band_of):
        n = cells(band_of)
        return F.pmod(F.floor((lon + 180.0) / 360.0 * n).cast("int"), n)

    a = left.withColumn("_band", band(F.col("l_lat"))).withColumn("_cell", cell(F.col("l_lon"), F.col("_band")))
    around = right.withColumn("_home", band(F.col("r_lat"))).withColumn("_band", F.explode(F.array(F.col("_home") - 1, F.col("_home"), F.col("_home") + 1)))
    n = cells(F.col("_band"))
    here = cell(F.col("r_lon"), F.col("_band"))
    b = around.withColumn("_cell", F.explode(F.array_distinct(F.array(F.pmod(here - 1, n), here, F.pmod(here + 1, n))))).drop("_home")
    keys = [*on, "_band", "_cell"]
    met = spread(a, *keys).join(spread(b, *keys).hint("merge"), keys).filter(F.abs(F.col("l_lat") - F.col("r_lat")) <= height)
    return met.withColumn("distance_m", haversine_m(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))).filter(F.col("distance_m") <= limit_m).drop("_band", "_cell")


def nearest_within(left: DataFrame, right: DataFrame, limit_m: float, keep) -> DataFrame:
    """(l_id, r_id, distance_m): the nearest right row within ``limit_m`` of each left row that has one; ties to the lesser id.

    The radius grows threefold for those that found none, so few rows meet all that is within the limit.
    """
    out, rest = None, left
    for k in range(3, -1, -1):
        near = within_distance(rest, right, limit_m / 3**k).groupBy("l_id").agg(F.min(F.struct("distance_m", "r_id")).alias("m"))
        got = keep.cut(near.select("l_id", "m.r_id", "m.distance_m"))
        out = got if out is None else out.unionByName(got)
        rest = rest.join(got, "l_id", "left_anti")
    return out


def nearest_planar(points: DataFrame, sites: DataFrame, on: str, k: int, keep) -> DataFrame:
    """(id, site): each point's ``k`` nearest sites of its ``on`` by |lat| + |lon| apart, ties to the lesser site, all if fewer.

    points: id, lat, lon, on; sites: site, lat, lon, on. They meet by squares of a side that holds about twice ``k`` sites; a
    point with fewer within that distance goes on with three times the side, at last as wide as everything.
    """
    both = points.select("lat", "lon").unionByName(sites.select("lat", "lon")).agg(*(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("low", F.min), ("high", F.max)))).first()
    high, wide = ((both[f"high_{c}"] or 0.0) - (both[f"low_{c}"] or 0.0) for c in ("lat", "lon"))
    most = sites.groupBy(on).count().agg(F.max("count")).first()[0] or 1
    whole = max(high + wide, 1e-6)
    reach, rest, out = min(math.sqrt(k * max(high, 1e-6) * max(wide, 1e-6) / most), whole), points.select("id", on, F.col("lat").alias("_a"), F.col("lon").alias("_b")), []
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    while True:
        last = reach >= whole
        at = lambda c: F.floor(F.col(c) / (reach * 1.000001))  # noqa: B023, E731
        near = sites.select("site", on, "lat", "lon").withColumn("_x", F.explode(F.transform(around, lambda s: at("lat") + s))).withColumn("_y", F.explode(F.transform(around, lambda s: at("lon") + s)))
        keys = [on, "_x", "_y"]
        far = F.abs(F.col("_a") - F.col("lat")) + F.abs(F.col("_b") - F.col("lon"))
        met = spread(rest.withColumns({"_x": at("_a"), "_y": at("_b")}), *keys).join(spread(near, *keys).hint("merge"), keys).withColumn("far", far)
        got = S.keep_best(met if last else met.filter(F.col("far") <= reach), ["id"], ["far", "site"], k).select("id", "site")
        got = keep.cut(got.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id"))).filter(F.lit(last) | (F.col("n") >= k)).drop("n"))
        out.append(got)
        rest = keep.cut(rest.join(got.select("id").distinct(), "id", "left_anti"))
        if last or rest.isEmpty():
            break
        reach = min(reach * 3, whole)
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every


def nearest_other(nodes: DataFrame, group: str, start_m: float = 200_000.0) -> DataFrame:
    """(id, near, distance_m): the nearest node of another group for each (id, lat, lon, group); ties to the lesser id.

    The radius grows sixteenfold for those that found none, up to half the globe, so the answer is exact.
    """
    out, left, limit = None, nodes, start_m
    while True:
        reach = min(limit, math.pi * 6371000 + 1)
        a = left.select(F.col("id").alias("l_id"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"), F.col(group).alias("l_group"))
        b = nodes.select(F.col("id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), F.col(group).alias("r_group"))
        pairs = within_distance(a, b, reach).filter("l_id <> r_id and not (l_group <=> r_group)")
        got = pairs.groupBy(F.col("l_id").alias("id")).agg(F.min(F.struct("distance_m", F.col("r_id").alias("near"))).alias("m")).select("id", "m.near", "m.distance_m")
        out = got if out is None else out.unionByName(got)
        if limit >= math.pi * 6371000:
            return out
        left = left.join(got, "id", "left_anti")
        limit = limit * 16


def nearest_cell(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Each point's nearest quarter-degree cell among those up to half a degree away: (id, cell, distance_m)."""
    steps = F.array(*(F.lit(k / 4) for k in range(-2, 3)))
    around = points.withColumn("_lat", round_quarter(F.col("lat"))).withColumn("_lon", round_quarter(F.col("lon")))
    around = around.withColumn("_lat", F.explode(F.transform(steps, lambda s: F.col("_lat") + s))).withColumn("_lon", F.explode(F.transform(steps, lambda s: F.col("_lon") + s)))
    # neither side is sent whole: Spark takes both for as small as before their rows were multiplied
    met = around.hint("merge").join(cells.select(F.col("cell"), F.col("cell_lat").alias("_lat"), F.col("cell_lon").alias("_lon")), ["_lat", "_lon"])
    far = haversine_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    return met.groupBy("id").agg(F.min(F.struct(far.alias("distance_m"), "cell")).alias("m")).select("id", "m.cell", "m.distance_m")


def in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Points (id, lat, lon) with the polygons (ring: array of (lon, lat), closed) that hold them.

    Both sides meet by grid cells of ``cell`` degrees: a polygon in every cell of its frame, a point in its own, so the join
    is an equi-join and a large polygon's points are spread over its cells.
    """
    from haulgraph.functions.geo import point_in_ring

    at = lambda x: F.floor(x / cell)
    ends = lambda f, c: at(f(F.transform("ring", lambda p: p[c])))
    rows = F.explode(F.sequence(ends(F.array_min, "lat"), ends(F.array_max, "lat"))).alias("row")
    held = polygons.select("*", rows).select("*", F.explode(F.sequence(ends(F.array_min, "lon"), ends(F.array_max, "lon"))).alias("column"))
    placed = points.select("id", "lat", "lon", at(F.col("lat")).alias("row"), at(F.col("lon")).alias("column"))
    return placed.join(held, ["row", "column"]).filter(point_in_ring(F.col("lon"), F.col("lat"), F.col("ring"))).drop("row", "column", "ring", "lat", "lon")
