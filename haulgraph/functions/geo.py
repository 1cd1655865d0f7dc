"""Geographic column functions. Everything is a JVM expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres, rounded up."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.ceil(F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))).cast("double")


def arc_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres, as they are."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def wrap(lon: Column) -> Column:
    """A longitude, or a difference of two, from -180 to 180; what is there already stays as it is."""
    return F.when(lon.between(-180, 180), lon).otherwise(F.pmod(lon + 180, F.lit(360.0)) - 180)


def round_quarter(x: Column) -> Column:
    """The nearest quarter of a degree, halves upward, the same way on both sides of zero."""
    return F.floor(x * 4 + 0.5) / 4.0


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def pad_extent(low: Column, high: Column, share: float = 0.03, least: float = 1.0) -> tuple[Column, Column]:
    pad = F.greatest((high - low) * share, F.lit(least))
    return low - pad, high + pad


def fibonacci_point(i: Column, n: int) -> tuple[Column, Column]:
    """Latitude and longitude of point i of an equal-area golden-angle lattice of n points."""
    golden = 137.50776405003785
    lat = F.degrees(F.asin(F.lit(1.0) - (i + 0.5) * (2.0 / n)))
    lon = F.pmod(i * golden, F.lit(360.0)) - 180.0
    return lat, lon


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting against a closed ring, an array of (lon, lat) structs."""
    n = F.size(ring)
    crossings = F.aggregate(
        F.sequence(F.lit(1), n - 1),
        F.lit(0),
        lambda acc, k: acc
        + F.when(
            ((F.element_at(ring, k)["lat"] > lat) != (F.element_at(ring, k + 1)["lat"] > lat))
            & (lon < (F.element_at(ring, k + 1)["lon"] - F.element_at(ring, k)["lon"]) * (lat - F.element_at(ring, k)["lat"]) / F.nullif(F.element_at(ring, k + 1)["lat"] - F.element_at(ring, k)["lat"], F.lit(0.0)) + F.element_at(ring, k)["lon"]),
            F.lit(1),
        ).otherwise(F.lit(0)),
    )
    return F.when(n < 4, F.lit(False)).otherwise(crossings % 2 == 1)


def ring_area_m2(ring: Column) -> Column:
    """Area on the sphere of a ring of (lon, lat) structs, closed or not."""
    n = F.size(ring)

    def side(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i % n + 1)
        return (F.radians(b["lon"]) - F.radians(a["lon"])) * (2 + F.sin(F.radians(a["lat"])) + F.sin(F.radians(b["lat"])))

    return F.abs(F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda t, i: t + side(i))) * (EARTH_M * EARTH_M / 2)


def sphere_point(i: Column) -> tuple[Column, Column]:
    """Latitude and longitude of point i of an even spread over the sphere, by hash."""
    share = lambda tag: F.conv(F.substring(F.md5(F.concat(i.cast("string"), F.lit(tag))), 1, 12), 16, 10).cast("long") / float(1 << 48)
    return F.degrees(F.asin(2 * share("#lat") - 1)), 360 * share("#lon") - 180
