"""Distances and centroids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * config.EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def ring_centroid(ring: Column) -> Column:
    """struct(x, y, area) of a closed ring of [x, y] points; a ring without area gives the mean of its points and area 0."""
    sides = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: F.struct(F.get(ring, i)[0].alias("x"), F.get(ring, i)[1].alias("y"), F.get(ring, i + 1)[0].alias("u"), F.get(ring, i + 1)[1].alias("v")))
    crossed = F.transform(sides, lambda s: F.struct((s.x * s.v - s.u * s.y).alias("w"), (s.x + s.u).alias("x"), (s.y + s.v).alias("y")))

    def add(f):
        return F.aggregate(crossed, F.lit(0.0), lambda t, s: t + f(s))

    double_area = add(lambda s: s.w)

    def mean(k: int) -> Column:
        return F.aggregate(ring, F.lit(0.0), lambda t, p: t + p[k]) / F.size(ring)

    flat = F.abs(double_area / 2) < 1e-9
    return F.when(flat | (F.size(ring) < 2), F.struct(mean(0).alias("x"), mean(1).alias("y"), F.lit(0.0).alias("area"))).otherwise(
        F.struct((add(lambda s: s.x * s.w) / (3 * double_area)).alias("x"), (add(lambda s: s.y * s.w) / (3 * double_area)).alias("y"), F.abs(double_area / 2).alias("area"))
    )


def shape_centroid(kind: Column, polygons: Column) -> Column:
    """struct(lat, lng) of a Polygon's outer ring or of a MultiPolygon's outer rings by area; other shapes get the fixed point."""
    rings = F.transform(polygons, lambda p: ring_centroid(F.get(p, F.lit(0))))
    area = F.aggregate(rings, F.lit(0.0), lambda t, r: t + r.area)

    def weighed(name: str) -> Column:
        return F.aggregate(rings, F.lit(0.0), lambda t, r: t + r[name] * r.area) / area

    last = F.element_at(rings, -1)
    many = F.when(area > 0, F.struct(weighed("y").alias("lat"), weighed("x").alias("lng"))).otherwise(F.struct(last.y.alias("lat"), last.x.alias("lng")))
    one = F.struct(F.get(rings, F.lit(0)).y.alias("lat"), F.get(rings, F.lit(0)).x.alias("lng"))
    fixed = F.struct(*[F.lit(v).alias(n) for n, v in zip(("lat", "lng"), config.FALLBACK_POINT, strict=True)])
    return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many).otherwise(fixed)
