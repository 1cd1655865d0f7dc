"""Polygons on the sphere: nearest ring within a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulgraph.functions.geo import EARTH_M, arc_m

from .spatial import in_polygons, within_distance


def unit(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def _cross(u, v):
    return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]


def _dot(u, v):
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def point_to_arc_m(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres from a point to the shorter great-circle arc between two others: across it, or to the nearer end."""
    p, a, b = unit(lat, lon), unit(lat1, lon1), unit(lat2, lon2)
    n = _cross(a, b)
    size = F.sqrt(_dot(n, n))
    within = (_dot(_cross(n, a), p) >= 0) & (_dot(_cross(b, n), p) >= 0) & (size > 1e-12)
    across = F.asin(F.least(F.abs(_dot(n, p)) / F.when(size > 1e-12, size).otherwise(F.lit(1.0)), F.lit(1.0))) * EARTH_M
    return F.when(within, across).otherwise(F.least(arc_m(lat, lon, lat1, lon1), arc_m(lat, lon, lat2, lon2)))


def sides(polygons: DataFrame, key: str) -> DataFrame:
    """(key, lat1, lon1, lat2, lon2) of the rings (arrays of (lon, lat), closed)."""
    numbers = F.when(F.size("ring") > 1, F.sequence(F.lit(1), F.size("ring") - 1))
    each = polygons.select(key, F.explode(F.transform(numbers, lambda i: F.struct(F.element_at("ring", i).alias("p"), F.element_at("ring", i + 1).alias("q")))).alias("s"))
    return each.select(key, F.col("s.p.lat").alias("lat1"), F.col("s.p.lon").alias("lon1"), F.col("s.q.lat").alias("lat2"), F.col("s.q.lon").alias("lon2"))


def nearest_polygon(points: DataFrame, polygons: DataFrame, key: str, limit_m: float, cell: float = 6.0) -> DataFrame:
    """(id, key, distance_m): for points (id, lat, lon) the polygon (key, ring) that holds them, at 0, or the nearest within the limit.

    Sides are great-circle arcs. Each is cut into stretches no longer than the limit, and a point meets those whose middle is
    within reach by the grid join, poles and date line included; the distance to the stretch itself decides. Ties, as of
    polygons that share a side, go to the lesser key.
    """
    n = F.greatest(F.ceil(arc_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) / limit_m), F.lit(1)).cast("int")
    a, b = unit(F.col("lat1"), F.col("lon1")), unit(F.col("lat2"), F.col("lon2"))
    whole = arc_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) / EARTH_M

    def along(share: Column) -> tuple[Column, Column]:
        """Latitude and longitude of the point a share of the way along the arc."""
        near = F.sin(whole) < 1e-12
        wa, wb = (F.when(near, 1 - share).otherwise(F.sin((1 - share) * whole) / F.sin(whole)), F.when(near, share).otherwise(F.sin(share * whole) / F.sin(whole)))
        v = [wa * x + wb * y for x, y in zip(a, b, strict=True)]
        return F.degrees(F.atan2(v[2], F.sqrt(v[0] * v[0] + v[1] * v[1]))), F.degrees(F.atan2(v[1], v[0]))

    cut = sides(polygons, key).withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    middle = along((F.col("i") + 0.5) / F.col("n"))
    reach = cut.select(F.col(key).alias("r_id"), middle[0].alias("r_lat"), middle[1].alias("r_lon"), "lat1", "lon1", "lat2", "lon2")
    met = within_distance(points.select(F.col("id").alias("l_id"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon")), reach, limit_m * 1.5 + 2)
    far = point_to_arc_m(F.col("l_lat"), F.col("l_lon"), F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    by_side = met.select(F.col("l_id").alias("id"), F.col("r_id").alias(key), far.alias("distance_m")).filter(F.col("distance_m") <= limit_m)
    held = in_polygons(points, polygons.select(key, "ring"), cell).select("id", key, F.lit(0.0).alias("distance_m"))
    best = F.min(F.struct("distance_m", key))
    return held.unionByName(by_side).groupBy("id").agg(best.alias("m")).select("id", f"m.{key}", "m.distance_m")
