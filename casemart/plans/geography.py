"""Places: mesh centroids, the distance matrix, road axes, peaks with their nearest facility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import geo
from ..functions import measures as m
from ..operators import rank

#: A mesh feature: code, kind of geometry, polygons of rings of [lng, lat] points (a Polygon is one polygon).
MESH = "codarea string, kind string, polygons array<array<array<array<double>>>>"


def located(lat: Column, lng: Column) -> Column:
    """Whether coordinates are there: neither is null or the placeholder 0."""
    return lat.isNotNull() & lng.isNotNull() & (lat != 0) & (lng != 0)


def municipal_points(mesh: DataFrame, dim: DataFrame) -> DataFrame:
    """The dimension with lat and lng (5 decimals) of each area's centroid; areas that the dimension lacks drop out."""
    centre = geo.shape_centroid(F.col("kind"), F.col("polygons"))
    points = mesh.select(F.col("codarea").alias("ibge_code"), centre.alias("_c"))
    return dim.join(points, "ibge_code").withColumns({"lat": F.round("_c.lat", 5), "lng": F.round("_c.lng", 5)}).drop("_c")


def distance_matrix(points: DataFrame, facilities: DataFrame) -> DataFrame:
    """For every municipality the nearest facility with coordinates, its town, the km (1 decimal) and the band of the exact km."""
    usable = facilities.filter(located(F.col("lat"), F.col("lon"))).select(F.col("sigla").alias("nearest"), F.col("lat").alias("_flat"), F.col("lon").alias("_flng"))
    found = rank.nearest(points, usable, "lat", "lng", "nearest", "_flat", "_flng")
    town = facilities.select(F.col("sigla").alias("nearest"), F.col("municipio").alias("nearest_town")).dropDuplicates(["nearest"])
    return found.join(town, "nearest", "left").withColumn("band", m.distance_band(F.col("km"))).withColumn("km", F.round("km", 1))


def road_counts(axes: DataFrame) -> DataFrame:
    """Axes, federal ones, state ones, points."""
    return axes.agg(F.count(F.lit(1)).alias("axes"), F.count_if(F.col("tipo") == "federal").alias("federal"), F.count_if(F.col("tipo") == "estadual").alias("state"), F.sum(F.size("coords")).alias("points"))


def road_points(axes: DataFrame) -> DataFrame:
    """name, nth, lat, lng of the points of axes, whose coordinates are [lat, lng]."""
    return axes.select("nome", F.posexplode("coords").alias("nth", "_p")).select("nome", "nth", F.col("_p")[0].alias("lat"), F.col("_p")[1].alias("lng"))


def peaks(rows: DataFrame, topics: dict[str, Column], facilities: DataFrame, name: str, region: str, n: int = 10) -> dict[str, DataFrame]:
    """The n largest values of each topic with the nearest facility, and the regions that hold several of a topic's peaks.

    rows: name, region, lat, lng and whatever `topics` reads; facilities: sigla, lat, lon.
    """
    top = rank.top_per_topic(rank.unpivot_topics(rows, [name, region, "lat", "lng"], topics), n, name)
    usable = facilities.filter(located(F.col("lat"), F.col("lon"))).select(F.col("sigla").alias("nearest"), F.col("lat").alias("_flat"), F.col("lon").alias("_flng"))
    near = rank.nearest(top, usable, "lat", "lng", "nearest", "_flat", "_flng")
    return {"peaks": near, "clusters": rank.clusters(top, region, "lat", "lng", name)}


def dynamic_peaks(rows: DataFrame, topics: dict[str, str], facilities: DataFrame, name: str, region: str, regions: tuple = (), metric: str = "rate", scale: int = config.RATE_SCALE, n: int = 10, population: str = "population") -> dict[str, DataFrame]:
    """`peaks` of count columns as a user asks for them: in all or some regions, by rate at a scale or by volume."""
    if metric not in ("rate", "volume"):
        raise ValueError(metric)
    chosen = rows.filter(F.col(region).isin(*regions)) if regions else rows

    def value(c: str) -> Column:
        return F.when(F.col(population) > 0, F.round(F.col(c) / F.col(population) * scale, 4)) if metric == "rate" else F.col(c)

    return peaks(chosen, {t: value(c) for t, c in topics.items()}, facilities, name, region, n)


def missing_fields(inventories: DataFrame) -> DataFrame:
    """file and its missing fields, joined for display."""
    known = F.array(*map(F.lit, sorted(config.ALIASES)))
    return inventories.select("file", F.array_join(F.array_except(known, "resolved"), ", ").alias("missing"))
