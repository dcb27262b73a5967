"""Distinct complaints that can be merged: over any years, halves and places from stored tables, without the fact.

Distinct counts don't add up where a complaint has records in several periods
or places. So each complaint gets a number, dense and in the order of its first
place and period, and the table by key holds one bit for each of its
complaints in buckets of 32,768 numbers. Complaints of a key have numbers that
lie together, so few buckets are touched, and bits are merged by `or`. Beside
them lies a sketch by key, of fixed size, for those who can do without the last
per cent.

Whether a complaint is penal in the majority depends on all its records
chosen. Nearly all complaints have one key, and count there once and for all;
those of several keys are kept as rows, and only these are summed again.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .aggregate import by_complaint

#: Complaints that one task numbers.
BLOCK = 1 << 20
#: log2 of a sketch's registers: a relative standard error of 1.6 %.
SKETCH = 12


class Complaints(NamedTuple):
    """numbers: id, number. bits: keys, bucket, complaints, penal. by_key: keys, majority of complaints with one key, two sketches. several: keys, number, n, p of complaints with more than one."""

    numbers: DataFrame
    bits: DataFrame
    by_key: DataFrame
    several: DataFrame


def numbered(per: DataFrame, keys: list[str], id_: str, known: DataFrame | None = None) -> DataFrame:
    """id, number of every complaint of `per` (keys, id): those of `known` keep theirs, new ones follow by first key, then id.

    A key with many complaints is dealt out in blocks, which are counted
    first; so no task numbers a key of any size.
    """
    first = per.groupBy(id_).agg(F.min(F.struct(*keys)).alias("_home"))
    base: Column = F.lit(0)
    if known is not None:
        first = first.join(known.select(id_), id_, "left_anti").crossJoin(F.broadcast(known.agg(F.coalesce(F.max("number") + 1, F.lit(0)).alias("_base"))))
        base = F.col("_base")
    else:
        first = first.withColumn("_base", base)
    homes = first.groupBy("_home").agg(F.count(F.lit(1)).alias("_size"))
    dealt = first.join(homes, "_home").withColumn("_block", F.pmod(F.xxhash64(id_), F.ceil(F.col("_size") / BLOCK)))
    before = Window.orderBy("_home", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each key and block
    starts = dealt.groupBy("_home", "_block").agg(F.count(F.lit(1)).alias("_n")).select("_home", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_home", "_block").orderBy(id_))
    new = dealt.withColumn("_nth", nth).join(starts, ["_home", "_block"]).select(id_, (F.col("_base") + F.col("_start") + F.col("_nth") - 1).cast("long").alias("number"))
    return new if known is None else known.select(id_, "number").unionByName(new)


def complaint_tables(fact: DataFrame, keys: list[str], id_: str, reliable: Column, penal: Column, known: DataFrame | None = None) -> Complaints:
    """The tables of all reliable complaints of a fact, by `keys` (none of them null). Store them with `save` and merge them with `merged`."""
    per = by_complaint(fact, keys, id_, reliable, F.coalesce(penal, F.lit(False)))
    numbers = numbered(per, keys, id_, known)
    rows = per.join(numbers, id_)
    place = F.bitmap_bit_position("number")
    bits = rows.groupBy(*keys, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(place).alias("complaints"), F.bitmap_construct_agg(F.when(F.col("p") > 0, place)).alias("penal")
    )
    places = rows.groupBy("number").agg(F.count(F.lit(1)).alias("_places"))
    counted = rows.join(places, "number")
    single = (F.col("_places") == 1) & (F.col("p") * 2 > F.col("n"))
    by_key = counted.groupBy(*keys).agg(
        F.count_if(single).alias("majority"), F.hll_sketch_agg("number", F.lit(SKETCH)).alias("sketch"), F.hll_sketch_agg(F.when(F.col("p") > 0, F.col("number")), F.lit(SKETCH)).alias("sketch_penal")
    )
    return Complaints(numbers, bits, by_key, counted.filter("_places > 1").select(*keys, "number", "n", "p"))


def save(tables: Complaints, out: str, partition: list[str] | None = None) -> Complaints:
    """Writes the tables below a path and returns them as read again. The numbers come first, as all others go by them."""
    spark = tables.bits.sparkSession
    for name, df in tables._asdict().items():
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partition) if partition and name != "numbers" else writer).parquet(f"{out}/{name}")
    return load(spark, out)


def load(spark: SparkSession, path: str) -> Complaints:
    return Complaints(*(spark.read.parquet(f"{path}/{name}") for name in Complaints._fields))


def merged(tables: Complaints, by: list[str], where: Column | None = None, sketched: bool = False) -> DataFrame:
    """By any of the keys, or none: denuncias_unicas, denuncias_unicas_penal, denuncias_unicas_maioria_penal of the chosen rows, exactly; with `sketched` also two estimates.

    Where nothing is chosen there is no row, but one of zeros for no keys.
    Null keys stay. The bits of a bucket meet in one buffer of 4 kB, after
    such buffers in every task.
    """

    def chosen(df: DataFrame) -> DataFrame:
        return df if where is None else df.filter(where)

    names = ["denuncias_unicas", "denuncias_unicas_penal", "denuncias_unicas_maioria_penal"]

    def part(df: DataFrame, **columns: Column) -> DataFrame:
        return df.select(*by, *[columns.get(n, F.lit(0)).cast("long").alias(n) for n in names])

    buckets = chosen(tables.bits).groupBy(*by, "bucket").agg(F.bitmap_or_agg("complaints").alias("_c"), F.bitmap_or_agg("penal").alias("_p"))
    again = chosen(tables.several).groupBy(*by, "number").agg((F.sum("p") * 2 > F.sum("n")).alias("_most"))
    parts = part(buckets, denuncias_unicas=F.bitmap_count("_c"), denuncias_unicas_penal=F.bitmap_count("_p"))
    parts = parts.unionByName(part(chosen(tables.by_key), denuncias_unicas_maioria_penal=F.col("majority"))).unionByName(part(again, denuncias_unicas_maioria_penal=F.col("_most")))
    exact = parts.groupBy(*by).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    if not sketched:
        return exact
    estimates = {"estimate": "sketch", "estimate_penal": "sketch_penal"}
    rough = chosen(tables.by_key).groupBy(*by).agg(*[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(n) for n, c in estimates.items()])
    if not by:
        return exact.crossJoin(F.broadcast(rough))  # a row each
    other = rough.select(*[F.col(c).alias(f"_{c}") for c in by], *estimates)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return exact.join(other, same).drop(*[f"_{c}" for c in by])
