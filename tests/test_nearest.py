import math
import random

import pytest
from pyspark.sql import functions as F

from casemart.operators import rank

POINT, UNIT = "id long, lat double, lng double", "f long, flat double, flng double"


def both(spark, points, units):
    """By the array and by cells."""
    p, u = spark.createDataFrame(points, POINT), spark.createDataFrame(units, UNIT)
    return ({r.id: (r.f, r.km) for r in rank.nearest(p, u, "lat", "lng", "f", "flat", "flng", as_array=n).collect()} for n in (10**9, 1))


def test_cells_find_what_the_array_finds(spark):
    rng = random.Random(3)

    def places(n, spread):
        return [(k, rng.gauss(0, spread) % 180 - 90, rng.uniform(-180, 180)) if k % 3 else (k, 89.9 - rng.random() / 10, rng.uniform(-180, 180)) for k in range(n)]

    points = [*places(300, 40), (1000, None, 1.0), (1001, 10.0, 179.99), (1002, 10.0, -179.99), (1003, 10.0, None)]
    units = [*places(400, 5), (900, 10.0, 179.98), (901, 10.0, 179.98), (902, None, 0.0)]
    a, b = both(spark, points, units)
    assert a == b and len(a) == 304 and a[1000] == a[1003] == (None, None) and a[1002][0] == 900


def test_ends_of_the_axes(spark):
    """Points where a coordinate of the sphere is 1 or -1: both poles, and the equator at 0, 90, 180 and -90."""
    rng = random.Random(4)
    points = [(k, *at) for k, at in enumerate([(0.0, 0.0), (0.0, 90.0), (90.0, 0.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -180.0), (0.0, -90.0), (90.0, 77.0)])]
    units = [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(299)]
    a, b = both(spark, points, units)
    assert a == b and all(f is not None for f, _ in b.values())
    # the poles and the equator as facilities too
    a, b = both(spark, [(k, rng.uniform(-90, 90), rng.uniform(-180, 180)) for k in range(200)], [p for p in points])
    assert a == b


def test_ties_take_the_smallest_key(spark):
    units = [(k, lat, lng) for k, (lat, lng) in enumerate([(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)] * 3, 5)]
    a, b = both(spark, [(1, 0.0, 0.0), (2, 0.9, 0.0)], units)
    assert a == b and b[1][0] == 5 and b[2][0] == 5


def test_one_name_or_one_place_for_many_points(spark):
    points = [(7, 0.0, 0.0), (7, 40.0, 40.0), (7, 40.0, 40.0), (8, 40.0, 40.0)]
    p, u = spark.createDataFrame(points, POINT), spark.createDataFrame([(k, 10.0 * k, 10.0 * k) for k in range(5)], UNIT)
    got = sorted((r.id, r.f) for r in rank.nearest(p, u, "lat", "lng", "f", "flat", "flng", as_array=1).collect())
    assert got == [(7, 0), (7, 4), (7, 4), (8, 4)]


def test_a_dense_town_is_not_unfolded(spark, monkeypatch):
    """10^5 facilities within 5 km, seen by points in it, 50 km off and far away: exact, and few of them are measured."""
    rng = random.Random(5)
    town = spark.range(100_000, numPartitions=4).select(F.col("id").alias("f"), (F.lit(-27.0) + F.rand(1) * 0.045).alias("flat"), (F.lit(-50.0) + F.rand(2) * 0.05).alias("flng"))
    rows = town.collect()
    points = [(k, -27.0 + rng.gauss(0, s), -50.0 + rng.gauss(0, s)) for k, s in enumerate([0.02] * 20 + [0.5] * 40 + [30.0] * 20)]
    measured = []
    real = rank.reduce

    def counted(join, frames):
        out = real(join, frames)
        measured.append(out)
        return out

    monkeypatch.setattr(rank, "reduce", counted)
    found = rank.nearest(spark.createDataFrame(points, POINT), spark.createDataFrame(rows, UNIT), "lat", "lng", "f", "flat", "flng").collect()
    got = {r.id: (r.f, r.km) for r in found}

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    for k, lat, lng in points:
        assert got[k][1] == pytest.approx(min(km(lat, lng, r.flat, r.flng) for r in rows), abs=1e-7)
    # cells at the end hold fewer facilities than FEW for each point, of 100,000 in reach
    assert measured[0].groupBy("_lat", "_lng").agg(F.max("held").alias("n")).agg(F.max("n")).first()[0] <= rank.FEW
