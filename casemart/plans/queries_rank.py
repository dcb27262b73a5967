"""Registered queries: rankings, windows, geography."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions import measures as m
from ..operators import aggregate as agg
from ..operators import rank
from ..operators.middle import medians
from ..scratch import scratch, stored
from ..sources import files
from . import geography
from .proxy import FACT, FLAGS, POPULATION, Book, fact, population, table

BOOK = Book()


def territories(spark, sf_dir):
    """territory, name, region, records, penal, population, rate and pseudo-coordinates."""
    rows = fact(spark, sf_dir).groupBy("territory", "territory_name", "region").agg(F.count(F.lit(1)).alias("records"), F.count_if("penal").alias("penal"), *[F.sum(f).alias(f) for f in FLAGS])
    return rows.join(population(spark, sf_dir), "territory", "left").withColumn("rate", m.rate(F.col("penal"), F.col("population"))).withColumn("lat", (F.col("territory") * 7 % 40 - 20).cast("double")).withColumn("lng", (F.col("territory") * 13 % 90 - 45).cast("double"))


T = FACT + f""", {POPULATION}, terr AS (SELECT territory, territory_name, region, count(*) AS records, CAST(count_if(penal) AS BIGINT) AS penal, {", ".join(f"CAST(sum({f}) AS BIGINT) AS {f}" for f in FLAGS)}, any_value(population) AS population,
  CASE WHEN any_value(population) > 0 THEN round(count_if(penal) / any_value(population) * 10000, 2) END AS rate, CAST(territory * 7 % 40 - 20 AS DOUBLE) AS lat, CAST(territory * 13 % 90 - 45 AS DOUBLE) AS lng
  FROM fact LEFT JOIN pop USING (territory) GROUP BY territory, territory_name, region) """


@BOOK.add(FACT + ", c AS (SELECT territory, p_type, count(*) AS n FROM fact WHERE penal GROUP BY ALL) SELECT territory, p_type, n FROM (SELECT *, row_number() OVER (PARTITION BY territory ORDER BY n DESC, p_type) AS r FROM c) WHERE r = 1")
def predominant_category(spark, sf_dir):
    return agg.predominant(fact(spark, sf_dir).filter("penal"), ["territory"], "p_type")


_TOPICS = {f[3:]: f"CASE WHEN population > 0 THEN round({f} / population * 10000, 4) END" for f in FLAGS}
_UNPIVOT = " UNION ALL ".join(f"SELECT territory_name, region, lat, lng, '{t}' AS topic, {e} AS value FROM terr" for t, e in _TOPICS.items())
_RANKED = T + f", u AS ({_UNPIVOT}), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY value DESC NULLS LAST, territory_name) AS rank FROM u QUALIFY rank <= 10)"


def peaks(spark, sf_dir):
    rows = territories(spark, sf_dir)
    values = {f[3:]: F.when(F.col("population") > 0, F.round(F.col(f) / F.col("population") * 10_000, 4)) for f in FLAGS}
    return rank.top_per_topic(rank.unpivot_topics(rows, ["territory_name", "region", "lat", "lng"], values), 10, "territory_name")


@BOOK.add(_RANKED + " SELECT topic, rank, territory_name, value FROM r")
def topn_per_topic(spark, sf_dir):
    return peaks(spark, sf_dir).select("topic", F.col("rank").cast("long").alias("rank"), "territory_name", "value")


@BOOK.add(_RANKED + " SELECT topic, region, count(*) AS peaks, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng, string_agg(territory_name, ',' ORDER BY rank) AS members FROM r GROUP BY topic, region HAVING count(*) >= 2")
def peak_clusters(spark, sf_dir):
    c = rank.clusters(peaks(spark, sf_dir), "region", "lat", "lng", "territory_name")
    return c.select("topic", "region", "peaks", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), F.array_join("members", ",").alias("members"))


FLOOR = 55_000


@BOOK.add(T + f"SELECT territory_name, penal, population, rate FROM terr WHERE rate IS NOT NULL AND population >= {FLOOR} ORDER BY rate DESC, territory_name LIMIT 5")
def rank_floor(spark, sf_dir):
    return rank.top(territories(spark, sf_dir), "rate", 5, "territory_name", ("population", FLOOR)).select("territory_name", "penal", "population", "rate")


@BOOK.add(T + "SELECT territory_name, penal FROM terr ORDER BY penal DESC, territory_name LIMIT 5")
def rank_volume(spark, sf_dir):
    return rank.top(territories(spark, sf_dir), "penal", 5, "territory_name").select("territory_name", "penal")


@BOOK.add(T + "SELECT territory_name, rate FROM terr WHERE rate IS NOT NULL ORDER BY rate, territory_name LIMIT 5")
def rank_lowest(spark, sf_dir):
    return rank.top(territories(spark, sf_dir), "rate", 5, "territory_name", smallest=True).select("territory_name", "rate")


@BOOK.add(T + """, p AS (SELECT CAST(f AS BIGINT) AS floor, territory_name, rate, row_number() OVER (PARTITION BY f ORDER BY rate DESC NULLS LAST, territory_name DESC) AS r, count(*) OVER (PARTITION BY f) AS n
FROM terr, (SELECT unnest([0, 45000, 50000, 60000]) AS f) WHERE population >= f) SELECT floor, n, territory_name AS leader, rate AS value FROM p WHERE r = 1""")
def floor_sensitivity(spark, sf_dir):
    return rank.floor_sensitivity(territories(spark, sf_dir), [0, 45_000, 50_000, 60_000], "rate", "population", "territory_name")


@BOOK.add(T + """, f AS (SELECT *, CASE WHEN population < 50000 THEN 'small' ELSE 'large' END AS size FROM terr WHERE population >= 40000), g AS (SELECT *, avg(records / population) OVER () AS mean FROM f)
SELECT territory_name, records, rate, CAST(row_number() OVER (ORDER BY rate DESC NULLS LAST, territory_name) AS BIGINT) AS position FROM g WHERE records / population >= mean AND (contains(lower(territory_name), 'a') OR contains(size, 'large'))""")
def table_filters(spark, sf_dir):
    """The municipal table: size band, above the mean of the rows left, then a text search, sorted and numbered."""
    rows = territories(spark, sf_dir).filter("population >= 40000").withColumn("per", F.col("records") / F.col("population")).withColumn("size", F.when(F.col("population") < 50_000, "small").otherwise("large"))
    mean = rows.agg(F.avg("per").alias("mean"))
    found = rows.crossJoin(F.broadcast(mean)).filter("per >= mean").filter(F.lower("territory_name").contains("a") | F.col("size").contains("large"))
    return rank.sorted_by(found, "rate", True, "territory_name", "position").select("territory_name", "records", "rate", F.col("position").cast("long").alias("position"))


_KM = "2 * 6371.0 * atan2(sqrt({a}), sqrt(1 - ({a})))".replace("{a}", "pow(sin(radians(flat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(flat)) * pow(sin(radians(flng - lng) / 2), 2)")
_NEAR = f"""WITH p AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE CAST(c_custkey * 37 % 1000 / 100.0 - 5 AS DOUBLE) END AS lat, CAST(c_custkey * 91 % 1000 / 100.0 - 5 AS DOUBLE) AS lng FROM customer),
f AS (SELECT s_suppkey, CAST(s_suppkey * 53 % 1000 / 100.0 - 5 AS DOUBLE) AS flat, CAST(s_suppkey * 29 % 1000 / 100.0 - 5 AS DOUBLE) AS flng FROM supplier),
d AS (SELECT c_custkey, s_suppkey, {_KM} AS km, row_number() OVER (PARTITION BY c_custkey ORDER BY {_KM}, s_suppkey) AS r FROM p, f WHERE lat IS NOT NULL),
n AS (SELECT p.c_custkey, c_acctbal, s_suppkey, km, CASE WHEN km IS NULL THEN 'unknown' WHEN km < 25 THEN 'near' WHEN km <= 50 THEN 'middle' ELSE 'far' END AS band FROM p LEFT JOIN (SELECT * FROM d WHERE r = 1) q ON p.c_custkey = q.c_custkey) """


def nearest(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_custkey") % 50 != 0, (F.col("c_custkey") * 37 % 1000 / 100.0 - 5).cast("double")).alias("lat"), (F.col("c_custkey") * 91 % 1000 / 100.0 - 5).cast("double").alias("lng"))
    facilities = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 53 % 1000 / 100.0 - 5).cast("double").alias("flat"), (F.col("s_suppkey") * 29 % 1000 / 100.0 - 5).cast("double").alias("flng"))
    found = rank.nearest(points, facilities, "lat", "lng", "s_suppkey", "flat", "flng")
    return found.withColumn("band", m.distance_band(F.col("km")))


@BOOK.add(_NEAR + "SELECT c_custkey, s_suppkey, round(km, 6) AS km, band FROM n")
def nearest_facility(spark, sf_dir):
    return nearest(spark, sf_dir).select("c_custkey", "s_suppkey", F.round("km", 6).alias("km"), "band")


@BOOK.add(_NEAR + "SELECT b AS band, count(c_custkey) AS n, round(avg(km * 1.4 / 60 * 60), 4) AS minutes, round(median(km), 4) AS median_km FROM (SELECT unnest(['near', 'middle', 'far', 'unknown']) AS b) LEFT JOIN n ON band = b GROUP BY b")
def band_summary(spark, sf_dir):
    """Every band, also one without rows."""
    bands = spark.createDataFrame([(b,) for b in ("near", "middle", "far", "unknown")], "band string")
    found = stored(nearest(spark, sf_dir).select("band", "km"), "distances")
    rows = found.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(m.travel_minutes(F.col("km"), 60)), 4).alias("minutes"))
    middle = medians(found, ["band"], "km").select("band", F.round("median", 4).alias("median_km"))
    return bands.join(rows, "band", "left").join(middle, "band", "left").fillna(0, ["n"])


@BOOK.add("SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS price, count(*) AS n FROM lineitem GROUP BY ALL")
def median_price(spark, sf_dir):
    """Medians of a few very large groups; no group's values lie in one buffer, as only 500 of them are ever sorted."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    keys = ["l_returnflag", "l_linestatus"]
    return lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(medians(lines, keys, "l_extendedprice", "price", most=500), keys)


@BOOK.add(_NEAR + "SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal, round(km, 4) AS km FROM n WHERE band = 'far' ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def far_with_most(spark, sf_dir):
    rows = nearest(spark, sf_dir).filter("band = 'far'")
    return rank.top(rows, "c_acctbal", 10, "c_custkey").select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"), F.round("km", 4).alias("km"))


@BOOK.add("""SELECT s_nationkey, count(*) AS n, count_if(s_acctbal > 0) AS has_a, count_if(s_suppkey % 2 = 0) AS has_b, count_if(s_acctbal > 5000 AND s_suppkey % 3 = 0) AS has_c FROM supplier GROUP BY s_nationkey""")
def service_counts(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("s_acctbal > 0")).alias("has_a"), F.count_if(F.expr("s_suppkey % 2 = 0")).alias("has_b"), F.count_if(F.expr("s_acctbal > 5000 and s_suppkey % 3 = 0")).alias("has_c"))


# A rectangle of w by h with its corner at (x, y), and for every third customer a second one beside it.
_W, _H, _X, _Y = "(1 + c_custkey % 7)", "(1 + c_custkey % 5)", "(c_custkey % 90)", "(c_custkey % 40)"


@BOOK.add(f"""WITH s AS (SELECT c_custkey, CAST({_W} AS DOUBLE) AS w, CAST({_H} AS DOUBLE) AS h, CAST({_X} AS DOUBLE) AS x, CAST({_Y} AS DOUBLE) AS y FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN -27.24 WHEN c_custkey % 3 = 0 THEN round((w * h * (y + h / 2) + w * w * (y + 50 + w / 2)) / (w * h + w * w), 6) ELSE round(y + h / 2, 6) END AS lat,
  CASE WHEN c_custkey % 11 = 0 THEN -50.21 WHEN c_custkey % 3 = 0 THEN round((w * h * (x + w / 2) + w * w * (x + 30 + w / 2)) / (w * h + w * w), 6) ELSE round(x + w / 2, 6) END AS lng FROM s""")
def polygon_centroid(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", *[F.expr(e).cast("double").alias(n) for n, e in (("w", _W), ("h", _H), ("x", _X), ("y", _Y))])

    def ring(x, y, w, h):
        return F.array(*[F.array(a, b) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))])

    x, y, w, h = (F.col(c) for c in "xywh")
    first, second = F.array(ring(x, y, w, h)), F.array(ring(x + 30, y + 50, w, w))
    kind = F.when(F.col("c_custkey") % 11 == 0, "Point").when(F.col("c_custkey") % 3 == 0, "MultiPolygon").otherwise("Polygon")
    shapes = F.when(F.col("c_custkey") % 3 == 0, F.array(first, second)).otherwise(F.array(first))
    centre = geo.shape_centroid(F.col("kind"), F.col("shapes"))
    return rows.select("c_custkey", kind.alias("kind"), shapes.alias("shapes")).withColumn("c", centre).select("c_custkey", F.round("c.lat", 6).alias("lat"), F.round("c.lng", 6).alias("lng"))


@BOOK.add(FACT + ", m AS (SELECT DISTINCT territory, CASE WHEN is_mulher = 1 THEN 'mulher' WHEN is_idoso = 1 THEN 'idoso' END AS module, ano FROM fact WHERE is_mulher = 1 OR is_idoso = 1) SELECT g AS module, min(ano) AS first_year, string_agg(DISTINCT ano, ',' ORDER BY ano) AS years FROM (SELECT unnest(['mulher', 'idoso', 'racial']) AS g) LEFT JOIN m ON module = g GROUP BY g")
def first_year_by_module(spark, sf_dir):
    rows = fact(spark, sf_dir).select(F.when(F.col("is_mulher") == 1, "mulher").when(F.col("is_idoso") == 1, "idoso").alias("module"), "ano").filter("module is not null").distinct()
    found = agg.first_seen(rows, "module", "ano", ["mulher", "idoso", "racial"])
    return found.select("module", "first_year", F.array_join(F.col("years").cast("array<string>"), ",").alias("years"))


_FACILITY = "SELECT CAST(s_suppkey AS VARCHAR) AS sigla, CAST(s_suppkey * 53 % 80 - 40 AS DOUBLE) AS flat, CAST(s_suppkey * 29 % 100 - 50 AS DOUBLE) AS flng FROM supplier"


def _units(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("sigla"), (F.col("s_suppkey") * 53 % 80 - 40).cast("double").alias("lat"), (F.col("s_suppkey") * 29 % 100 - 50).cast("double").alias("lon"))


@BOOK.add(T + f""", f AS ({_FACILITY}), c AS (SELECT topic, territory_name, lat, lng, value, row_number() OVER (PARTITION BY topic ORDER BY value DESC NULLS LAST, territory_name) AS rank
FROM (SELECT *, unnest(['mulher', 'idoso']) AS topic, unnest([round(is_mulher / nullif(population, 0) * 100000, 4), round(is_idoso / nullif(population, 0) * 100000, 4)]) AS value FROM terr WHERE region IN (1, 2))),
d AS (SELECT c.*, sigla, {_KM} AS km, row_number() OVER (PARTITION BY topic, rank ORDER BY {_KM}, sigla) AS nth FROM c, f WHERE rank <= 3 AND flat <> 0 AND flng <> 0) SELECT topic, CAST(rank AS BIGINT) AS rank, territory_name, value, sigla AS nearest, round(km, 4) AS km FROM d WHERE nth = 1""")
def dynamic_peaks(spark, sf_dir):
    """Peaks of chosen groups in chosen regions, per 100,000 inhabitants."""
    rows = territories(spark, sf_dir).filter("population is null or population >= 0")
    found = geography.dynamic_peaks(rows, {"mulher": "is_mulher", "idoso": "is_idoso"}, _units(spark, sf_dir), "territory_name", "region", regions=(1, 2), metric="rate", scale=100_000, n=3)["peaks"]
    return found.select("topic", F.col("rank").cast("long").alias("rank"), "territory_name", "value", "nearest", F.round("km", 4).alias("km"))


@BOOK.add(_RANKED + f", f AS ({_FACILITY}), d AS (SELECT topic, rank, territory_name, value, sigla, {_KM} AS km, row_number() OVER (PARTITION BY topic, rank ORDER BY {_KM}, sigla) AS nth FROM r, f WHERE flat <> 0 AND flng <> 0) SELECT topic, rank, territory_name, value, sigla AS nearest, round(km, 4) AS km FROM d WHERE nth = 1")
def peaks_with_facility(spark, sf_dir):
    """Every topic's ten peaks with the nearest facility that has coordinates."""
    units = _units(spark, sf_dir)
    values = {f[3:]: F.when(F.col("population") > 0, F.round(F.col(f) / F.col("population") * 10_000, 4)) for f in FLAGS}
    found = geography.peaks(territories(spark, sf_dir), values, units, "territory_name", "region")["peaks"]
    return found.select("topic", F.col("rank").cast("long").alias("rank"), "territory_name", "value", "nearest", F.round("km", 4).alias("km"))


@BOOK.add(f"""WITH m AS (SELECT n_nationkey, n_name, CAST(n_nationkey * 3 % 40 - 54 AS DOUBLE) AS lng, CAST(n_nationkey * 2 % 30 - 29 AS DOUBLE) AS lat FROM nation WHERE n_nationkey <> 5), f AS ({_FACILITY}),
d AS (SELECT n_name, sigla, {_KM} AS km, row_number() OVER (PARTITION BY n_nationkey ORDER BY {_KM}, sigla) AS nth FROM m, f WHERE flat <> 0 AND flng <> 0)
SELECT n_name AS municipio_nome, sigla AS nearest, 'town ' || sigla AS nearest_town, round(km, 1) AS km, CASE WHEN km < 25 THEN 'near' WHEN km <= 50 THEN 'middle' ELSE 'far' END AS band FROM d WHERE nth = 1""")
def distance_matrix(spark, sf_dir):
    """Areas of a mesh, their centroids joined to the dimension, and the nearest facility that has coordinates; an area that the dimension lacks drops out."""
    nations = table(spark, sf_dir, "nation")
    x, y = (F.col("n_nationkey") * 3 % 40 - 55).cast("double"), (F.col("n_nationkey") * 2 % 30 - 30).cast("double")
    ring = F.array(*[F.array(x + dx, y + dy) for dx, dy in ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))])
    mesh = nations.select(F.col("n_nationkey").cast("string").alias("codarea"), F.lit("Polygon").alias("kind"), F.array(F.array(ring)).alias("polygons"))
    dim = nations.filter("n_nationkey <> 5").select(F.col("n_nationkey").cast("string").alias("ibge_code"), F.col("n_name").alias("municipio_nome"))
    units = _units(spark, sf_dir).withColumn("municipio", F.concat(F.lit("town "), F.col("sigla")))
    return geography.distance_matrix(geography.municipal_points(mesh, dim), units).select("municipio_nome", "nearest", "nearest_town", "km", "band")


# Areas of a mesh file, a customer each: a square, two squares of which one has a hole, or a point; one in eleven has no code.
_AREA = """WITH a AS (SELECT c_custkey AS k, CAST(c_custkey * 3 % 80 - 60 AS DOUBLE) AS x, CAST(c_custkey * 7 % 60 - 50 AS DOUBLE) AS y FROM customer WHERE c_custkey % 11 <> 5),
m AS (SELECT k, CASE k % 3 WHEN 0 THEN -50.21 WHEN 1 THEN x + 1 ELSE round((4 * (x + 1) + (x + 10.5)) / 5, 5) END AS lng, CASE k % 3 WHEN 0 THEN -27.24 WHEN 1 THEN y + 1 ELSE round((4 * (y + 1) + (y + 5.5)) / 5, 5) END AS lat FROM a)"""


@BOOK.add(_AREA + f", f AS ({_FACILITY}), d AS (SELECT k, lat, lng, sigla, {_KM} AS km, row_number() OVER (PARTITION BY k ORDER BY {_KM}, sigla) AS nth FROM m, f WHERE flat <> 0 AND flng <> 0) SELECT CAST(k AS VARCHAR) AS ibge_code, lat, lng, sigla AS nearest, round(km, 1) AS km FROM d WHERE nth = 1")
def mesh_from_files(spark, sf_dir):
    """GeoJSON from file to distance matrix: areas of three kinds of geometry, whose coordinates are not equally deep, in several collections."""
    k, out = F.col("c_custkey"), scratch(spark, "mesh")
    x, y = (k * 3 % 80 - 60).cast("double"), (k * 7 % 60 - 50).cast("double")

    def square(dx, dy, side):
        return F.array(*[F.array(x + dx + a * side, y + dy + b * side) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])

    kind = F.when(k % 3 == 0, "Point").when(k % 3 == 1, "Polygon").otherwise("MultiPolygon")
    depth = F.when(k % 3 == 0, F.to_json(F.array(x, y))).when(k % 3 == 1, F.to_json(F.array(square(0, 0, 2)))).otherwise(F.to_json(F.array(F.array(square(0, 0, 2), square(0.5, 0.5, 1)), F.array(square(10, 5, 1)))))
    code = F.when(k % 11 == 5, " ").otherwise(k.cast("string"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{"codarea":"'), code, F.lit('"},"geometry":{"type":"'), kind, F.lit('","coordinates":'), depth, F.lit("}}"))
    people = table(spark, sf_dir, "customer")
    features = people.select(F.floor(k / 500).alias("file"), feature.alias("f")).groupBy("file").agg(F.collect_list("f").alias("all"))  # 500 areas a file
    features.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("all", ",\n"), F.lit("]}")).alias("value")).repartition("value").write.option("maxRecordsPerFile", 1).text(out)
    dim = people.select(k.cast("string").alias("ibge_code"))
    units = _units(spark, sf_dir).withColumn("municipio", F.lit(""))
    return geography.distance_matrix(geography.municipal_points(files.read_mesh(spark, out), dim), units).select("ibge_code", "lat", "lng", "nearest", "km")


@BOOK.add("""WITH o AS (SELECT o_custkey, list([CAST(o_orderkey % 90 AS DOUBLE), CAST(o_orderkey % 45 AS DOUBLE)] ORDER BY o_orderkey) AS coords FROM orders GROUP BY 1)
SELECT count(*) AS axes, count_if(o_custkey % 3 = 0) AS federal, count_if(o_custkey % 3 <> 0) AS state, CAST(sum(len(coords)) AS BIGINT) AS points FROM o""")
def road_axes(spark, sf_dir):
    """A customer's orders as an axis of points."""
    return geography.road_counts(_axes(spark, sf_dir))


@BOOK.add("""SELECT o_custkey AS nome, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS nth, CAST(o_orderkey % 90 AS DOUBLE) AS lat, CAST(o_orderkey % 45 AS DOUBLE) AS lng FROM orders""")
def road_points(spark, sf_dir):
    return geography.road_points(_axes(spark, sf_dir))


def _axes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    point = F.array((F.col("o_orderkey") % 90).cast("double"), (F.col("o_orderkey") % 45).cast("double"))
    rows = o.groupBy(F.col("o_custkey").alias("nome")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", point.alias("p")))).alias("s"))
    return rows.select("nome", F.when(F.col("nome") % 3 == 0, "federal").otherwise("estadual").alias("tipo"), F.transform("s", lambda x: x.p).alias("coords"))
