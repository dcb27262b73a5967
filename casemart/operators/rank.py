"""Rankings, top-k and windows over aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, metric: str, n: int, tie: str, floor: tuple[str, int] | None = None, smallest: bool = False) -> DataFrame:
    """The n rows with the largest (or smallest) metric that is not null, with a floor on another column if asked for."""
    rows = df.filter(F.col(metric).isNotNull())
    if floor:
        rows = rows.filter(F.col(floor[0]) >= floor[1])
    return rows.orderBy(F.asc(metric) if smallest else F.desc(metric), tie).limit(n)


def sorted_by(df: DataFrame, key: str, descending: bool, tie: str, position: str | None = None) -> DataFrame:
    """Sorted with nulls last; with `position`, numbered from 1 (for frames that a user looks at, whose rows are few)."""
    order = [F.desc_nulls_last(key) if descending else F.asc_nulls_last(key), F.asc(tie)]
    if position:
        return df.withColumn(position, F.row_number().over(Window.orderBy(*order)))
    return df.orderBy(*order)


def unpivot_topics(df: DataFrame, keys: list[str], topics: dict[str, Column]) -> DataFrame:
    """keys, topic, value: one row for each topic."""
    pairs = F.array(*[F.struct(F.lit(t).alias("topic"), c.cast("double").alias("value")) for t, c in topics.items()])
    return df.select(*keys, F.explode(pairs).alias("t")).select(*keys, "t.topic", "t.value")


def top_per_topic(rows: DataFrame, n: int, tie: str) -> DataFrame:
    """The n largest values of each topic, with their rank."""
    w = Window.partitionBy("topic").orderBy(F.desc_nulls_last("value"), tie)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def clusters(ranked: DataFrame, region: str, lat: str, lng: str, member: str, least: int = 2) -> DataFrame:
    """Regions with several of a topic's peaks: their number, mean point and members by rank."""
    members = F.transform(F.sort_array(F.collect_list(F.struct("rank", member))), lambda x: x[member])
    return ranked.groupBy("topic", region).agg(F.count(F.lit(1)).alias("peaks"), F.avg(lat).alias("lat"), F.avg(lng).alias("lng"), members.alias("members")).filter(F.col("peaks") >= least)


def leader_ratio(df: DataFrame, count: str, population: str, name: str, scale: int) -> DataFrame:
    """The row with the highest rate, the pooled rate of all rows, and the first over the second."""
    rate = F.when(F.col(population) > 0, F.col(count) / F.col(population) * scale)
    rows = df.withColumn("_rate", rate)
    pooled = F.sum(F.when(F.col(population) > 0, F.col(count))) / F.sum(F.when(F.col(population) > 0, F.col(population))) * scale
    return rows.agg(F.max_by(name, F.struct("_rate", name)).alias("leader"), F.max("_rate").alias("leader_rate"), pooled.alias("pooled_rate")).withColumn("ratio", F.col("leader_rate") / F.col("pooled_rate"))


def floor_sensitivity(df: DataFrame, floors: list[int], metric: str, population: str, name: str) -> DataFrame:
    """The leader by metric for each population floor."""
    wanted = df.sparkSession.createDataFrame([(f,) for f in floors], "floor long")
    pairs = df.join(F.broadcast(wanted), F.col(population) >= F.col("floor"))
    return pairs.groupBy("floor").agg(F.count(F.lit(1)).alias("n"), F.max_by(name, F.struct(metric, name)).alias("leader"), F.max(metric).alias("value"))


#: Facilities that travel to every point as one array; more are found by cells.
AS_ARRAY = 256
#: Sizes of cells: the whole globe, then a quarter as wide each time, down to about 12 m.
LEVELS = range(0, 21, 2)
#: Facilities that are measured one by one for a point; where more are in reach, smaller cells sort them out first.
FEW = 48


def nearest(points: DataFrame, facilities: DataFrame, lat: str, lng: str, f_key: str, f_lat: str, f_lng: str, as_array: int = AS_ARRAY) -> DataFrame:
    """points with f_key and km of the nearest facility, of equally near ones the smallest f_key; null where a point has no coordinates.

    Up to `as_array` facilities, which is checked, are broadcast as one array,
    so every point finds its nearest in place; more are dealt out by cells,
    once for each place, however many points it has.
    """
    from ..functions.geo import haversine_km

    usable = facilities.filter(F.col(f_lat).isNotNull() & F.col(f_lng).isNotNull()).select(F.col(f_key).alias("k"), F.col(f_lat).cast("double").alias("lat"), F.col(f_lng).cast("double").alias("lng"))
    if usable.limit(as_array + 1).count() > as_array:
        placed = points.select(F.col(lat).cast("double").alias("_lat"), F.col(lng).cast("double").alias("_lng")).dropna().distinct()
        best = nearest_by_cells(placed, usable)
        same = (F.col(lat).cast("double") == F.col("_lat")) & (F.col(lng).cast("double") == F.col("_lng"))
        return points.join(best, same, "left").drop("_lat", "_lng").withColumnRenamed("_k", f_key)
    one = usable.agg(F.sort_array(F.collect_list(F.struct("k", "lat", "lng"))).alias("_all"))
    with_all = points.crossJoin(F.broadcast(one))
    measured = F.transform("_all", lambda f: F.struct(haversine_km(F.col(lat), F.col(lng), f.lat, f.lng).alias("km"), f.k.alias("k")))
    best = F.when(F.col(lat).isNotNull() & F.col(lng).isNotNull(), F.array_min(measured))
    return with_all.withColumn("_best", best).withColumns({f_key: F.col("_best.k"), "km": F.col("_best.km")}).drop("_all", "_best")


AXES = ("x", "y", "z")
CELL = ["level", "cx", "cy", "cz"]


def _sphere(df: DataFrame, lat: str, lng: str) -> DataFrame:
    """Places as points of the unit sphere, so neither poles nor the date line matter."""
    a, b = F.radians(lat), F.radians(lng)
    return df.withColumns({"x": F.cos(a) * F.cos(b), "y": F.cos(a) * F.sin(b), "z": F.sin(a)})


def _cell(value: Column, level: Column) -> Column:
    """The number of the cell along an axis; the far end of the axis belongs to the last one."""
    return F.least(F.floor((value + 1) * F.pow(F.lit(2.0), level - 1)), F.pow(F.lit(2.0), level).cast("long") - 1)


def _in_cells(df: DataFrame) -> DataFrame:
    levels = F.explode(F.array(*map(F.lit, LEVELS))).alias("level")
    return df.select("*", levels).withColumns({f"c{c}": _cell(F.col(c), F.col("level")) for c in AXES})


def _squared(*gaps: Column) -> Column:
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])


def nearest_by_cells(points: DataFrame, facilities: DataFrame) -> DataFrame:
    """_lat, _lng, _k, km of the nearest facility (k, lat, lng) of every place (_lat, _lng), exactly and without a product of the two.

    Facilities lie in cubic cells of many sizes; each cell knows how many it
    holds, the box around them and one of them. One facility of the smallest
    cell around a point that has any bounds the distance; cells at least as
    wide as the bound then hold all that is nearer in the point's own cell and
    the 26 around it. Where their boxes in reach hold few facilities these are
    measured. Else the point walks down: cells are replaced by those in them,
    the nearest cell's facility lowers the bound, and boxes beyond it drop
    out; so what is far off in a dense town is never unfolded.
    """
    from ..functions.geo import haversine_km
    from ..scratch import stored

    units = stored(_in_cells(_sphere(facilities.groupBy("lat", "lng").agg(F.min("k").alias("k")), "lat", "lng")), "facility-places")
    boxes = [f(c).alias(f"{n}{c}") for c in AXES for n, f in (("low_", F.min), ("high_", F.max))]
    cells = units.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", *AXES)).alias("one"), *boxes)
    cells = stored(cells, "facility-cells")
    to_one = _squared(*[F.col(c) - F.col(f"one.{c}") for c in AXES])
    to_box = _squared(*[F.greatest(F.col(f"low_{c}") - F.col(c), F.col(c) - F.col(f"high_{c}"), F.lit(0.0)) for c in AXES])
    place = ["_lat", "_lng"]
    # a square of a chord, whose ends are right to 16 digits, widened by some thousand times their error
    slack = F.col("bound") * (1 + 1e-9) + F.sqrt("bound") * 1e-12 + 1e-24

    placed = _in_cells(_sphere(points, *place)).join(cells.select(*CELL, "one"), CELL)
    bound = placed.groupBy(*place, *AXES).agg(F.min(to_one).alias("bound"))
    width = F.greatest(F.sqrt(slack), F.lit(2.0**-30))
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS[-1]), F.floor(F.log2(F.lit(2.0) / width) / LEVELS.step) * LEVELS.step)).cast("int")
    near = bound.withColumn("level", level)
    for c in AXES:
        own = _cell(F.col(c), F.col("level"))
        near = near.withColumn(f"c{c}", F.explode(F.array(own - 1, own, own + 1)))
    reach = near.join(cells, CELL).filter(to_box <= slack)

    def kept(candidates: DataFrame) -> DataFrame:
        """Candidates within the bound of their point, with the number of facilities that all of them hold."""
        at = Window.partitionBy(*place)
        lowered = candidates.withColumn("bound", F.least("bound", F.min(to_one).over(at))).filter(to_box <= slack)
        return lowered.withColumn("held", F.sum("n").over(at)).select(*place, *AXES, "bound", *CELL, "held")

    done, rest = [], stored(kept(reach), "near-cells")
    inner = cells.select(*[F.col(c).alias(f"in_{c}") for c in CELL], *[F.floor(F.col(c) / 2**LEVELS.step).alias(f"up_{c}") for c in CELL[1:]], "n", "one", *[f"{n}{c}" for c in AXES for n in ("low_", "high_")])
    while True:
        last = (F.col("held") <= FEW) | (F.col("level") == LEVELS[-1])
        done.append(rest.filter(last))
        rest = rest.filter(~last)
        if rest.isEmpty():
            break
        inside = (F.col("in_level") == F.col("level") + LEVELS.step) & (F.col("up_cx") == F.col("cx")) & (F.col("up_cy") == F.col("cy")) & (F.col("up_cz") == F.col("cz"))
        below = rest.drop("held").join(inner, inside).drop(*CELL, "up_cx", "up_cy", "up_cz").withColumnsRenamed({f"in_{c}": c for c in CELL})
        rest = stored(kept(below), "near-cells")
    found = reduce(DataFrame.unionByName, done).select(*place, *CELL).join(units.select(*CELL, "k", "lat", "lng"), CELL)
    km = haversine_km(F.col("_lat"), F.col("_lng"), F.col("lat"), F.col("lng"))
    return found.groupBy(*place).agg(F.min(F.struct(km.alias("km"), "k")).alias("b")).select(*place, F.col("b.k").alias("_k"), "b.km")
