"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored

#: Buckets that a group's range is cut into, and the most values of a group that are sorted.
BUCKETS, SORTED = 1_024, 50_000
LARGEST = 1.7976931348623157e308


def _part(v: Column, low: Column, high: Column) -> Column:
    """Where v lies between low and high, from 0 to 1: by magnitude while these are powers apart, then by value. It never falls where v grows."""

    def magnitude(x: Column) -> Column:
        return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.ln(F.abs(x)) + 750))  # the least double is e to -744.4

    powers = magnitude(high) - magnitude(low)
    return F.when(powers > 2, (magnitude(v) - magnitude(low)) / powers).otherwise((v / 2 - low / 2) / (high / 2 - low / 2))


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median", most: int = SORTED) -> DataFrame:
    """keys and the median of `value` of every group with one; null and NaN don't count, infinities are the largest numbers.

    Bounds and size of each group come first. While a group's range holds more
    than `most` values it is cut into buckets, whose counts tell in which one
    the middle lies, and only that one is looked at further. Two middle values
    in two buckets are the greatest of one and the least of the other. So no
    buffer holds more than `most` values or BUCKETS counts, whatever is in a
    group, and rows are dealt out after counts in every task.
    """
    if not keys:
        return medians(df.withColumn("_all", F.lit(0)), ["_all"], value, name, most).drop("_all")
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_v", F.least(F.greatest("_v", F.lit(-LARGEST)), F.lit(LARGEST)))
    here = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ids = [f"_k{i}" for i in range(len(keys))]
    state = rows.groupBy(*here).agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count(F.lit(1)).alias("held"))
    first, second = F.floor((F.col("held") - 1) / 2), F.floor(F.col("held") / 2)
    # ranks of the two middle values among those that are still held
    state = stored(state.withColumns({"a": first, "b": second}), "median-bounds")
    same: Column = F.lit(True)
    for k, i in zip(keys, ids):
        same = same & F.col(k).eqNullSafe(F.col(i))

    def held(chosen: DataFrame) -> DataFrame:
        return rows.join(chosen, same).filter(F.col("_v").between(F.col("low"), F.col("high")))

    none = F.lit(None).cast("double")
    done = []
    while True:
        one = F.col("low") == F.col("high")
        done.append(state.filter(one).select(*ids, F.col("low").alias("x"), F.col("high").alias("y")))
        few = state.filter(~one & (F.col("held") <= most))
        lists = held(few).groupBy(*ids, "a", "b").agg(F.sort_array(F.collect_list("_v")).alias("s"))
        done.append(lists.select(*ids, F.get("s", F.col("a").cast("int")).alias("x"), F.get("s", F.col("b").cast("int")).alias("y")))
        rest = state.filter(~one & (F.col("held") > most))
        if rest.isEmpty():
            break
        bucket = F.least(F.floor(_part(F.col("_v"), F.col("low"), F.col("high")) * BUCKETS), F.lit(BUCKETS - 1))
        counts = held(rest).groupBy(*ids, "a", "b", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*ids).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        middle = counts.withColumn("before", before).filter((F.col("before") <= F.col("b")) & (F.col("before") + F.col("n") > F.col("a")))
        cut = middle.groupBy(*ids).agg(F.count(F.lit(1)).alias("parts"), F.max("a").alias("a"), F.max("b").alias("b"), F.min("before").alias("before"), F.sum("n").alias("held"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("high").alias("x"), F.max("low").alias("y"))
        cut = stored(cut, "median-buckets")
        done.append(cut.filter("parts = 2").select(*ids, "x", "y"))
        state = cut.filter("parts = 1").select(*ids, "low", "high", "held", (F.col("a") - F.col("before")).alias("a"), (F.col("b") - F.col("before")).alias("b"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*[F.col(i).alias(k) for k, i in zip(keys, ids)], F.coalesce(F.col("x") * 0.5 + F.col("y") * 0.5, none).alias(name))
