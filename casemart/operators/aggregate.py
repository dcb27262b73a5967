"""Aggregates on two grains: records, and complaints where their id is reliable."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_complaint(df: DataFrame, keys: list[str], id_: str, reliable: Column, penal: Column) -> DataFrame:
    """keys, id, n (records), p (penal records) of every reliable complaint."""
    return df.filter(reliable & F.col(id_).isNotNull()).groupBy(*keys, id_).agg(F.count(F.lit(1)).alias("n"), F.sum(penal.cast("long")).alias("p"))


def two_grain(df: DataFrame, keys: list[str], id_: str, reliable: Column, penal: Column, sums: dict[str, Column] | None = None) -> DataFrame:
    """Per key: records, penal records, `sums`, and of reliable complaints all, those with a penal record, and those whose records are penal in the majority.

    Two levels: first a row for every key and complaint, then one for every
    key. The distinct counts need no Expand, partial sums shrink the data
    before either shuffle, and a large key is many complaints on the first
    level. Records without a reliable id meet in one row a key, after partial
    sums.
    """
    return second_grain(first_grain(df, keys, id_, reliable, penal, sums), keys, sums or {})


#: What the first grain adds to its keys besides `sums`.
GRAIN = ("_id", "_rel")


def first_grain(df: DataFrame, keys: list[str], id_: str, reliable: Column, penal: Column, sums: dict[str, Column] | None = None) -> DataFrame:
    """A row for every key and complaint, with sums. Such rows of several batches are merged by `merge_first`."""
    rel = F.coalesce(reliable, F.lit(False)) & F.col(id_).isNotNull()
    return df.groupBy(*keys, F.when(rel, F.col(id_)).alias("_id"), rel.alias("_rel")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce(penal, F.lit(False)).cast("long")).alias("_p"), *[F.sum(c).alias(n) for n, c in (sums or {}).items()]
    )


def merge_first(states: DataFrame, keys: list[str], sums: Iterable[str] = ()) -> DataFrame:
    """Rows of the first grain, of several batches or of finer keys, as one for every key and complaint."""
    return states.groupBy(*keys, *GRAIN).agg(*[F.sum(c).alias(c) for c in ("_n", "_p", *sums)])


def second_grain(first: DataFrame, keys: list[str], sums: Iterable[str] = ()) -> DataFrame:
    return first.groupBy(*keys).agg(
        F.sum("_n").alias("records"),
        F.sum("_p").alias("penal"),
        F.sum(F.when(F.col("_rel"), F.col("_n")).otherwise(0)).alias("reliable_records"),
        F.count_if("_rel").alias("complaints"),
        F.count_if(F.col("_rel") & (F.col("_p") > 0)).alias("complaints_penal"),
        F.count_if(F.col("_rel") & (F.col("_p") * 2 > F.col("_n"))).alias("complaints_majority"),
        *[F.sum(n).alias(n) for n in sums],
    )


def decomposition(complaints: DataFrame) -> DataFrame:
    """Of `by_complaint` rows without territory: complaints, those with no penal record, with some, with a majority, with all."""
    return complaints.agg(
        F.count(F.lit(1)).alias("complaints"),
        F.count_if(F.expr("p = 0")).alias("none_penal"),
        F.count_if(F.expr("p > 0")).alias("some_penal"),
        F.count_if(F.expr("p * 2 > n")).alias("majority_penal"),
        F.count_if(F.expr("p = n")).alias("all_penal"),
    )


def value_counts(df: DataFrame, column: str, where: Column | None = None, name: str = "n") -> DataFrame:
    """Counts by value, largest first, then by value."""
    rows = df if where is None else df.filter(where)
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), F.asc_nulls_last(column))


def resum(df: DataFrame, keys: list[str], where: Column | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """All numeric columns but the keys summed over chosen rows. Null keys stay. Complaints of several periods are counted once for each."""
    numeric = [f.name for f in df.schema if f.dataType.typeName() in ("long", "integer", "double", "float", "short", "decimal") and f.name not in (*keys, *skip)]
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numeric])


def halves(df: DataFrame, year: str = "ano", half: str = "semestre") -> DataFrame:
    """Per year the halves it covers (a whole-year file covers two) and whether it is incomplete."""
    seen = F.collect_set(half)
    return df.groupBy(year).agg(seen.alias("_h")).select(year, F.when(F.col("_h") == F.array(F.lit(0)), 2).otherwise(F.size("_h")).alias("halves"), ((F.size("_h") < 2) & (F.col("_h") != F.array(F.lit(0)))).alias("incomplete"))


def share_of_total(df: DataFrame, column: str, name: str = "share") -> DataFrame:
    """Each row's percentage of the column's total, which is one aggregate row and no window over all rows."""
    total = df.agg(F.sum(column).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.when(F.col("_total") != 0, 100 * F.col(column) / F.col("_total"))).drop("_total")


def pivot_top(df: DataFrame, row: str, column: str, value: str, n: int) -> DataFrame:
    """Sums by row for the n columns with the largest totals; absent cells are 0."""
    top = [r[0] for r in df.groupBy(column).agg(F.sum(value).alias("_t")).orderBy(F.desc("_t"), column).limit(n).collect()]
    return df.groupBy(row).pivot(column, top).agg(F.sum(value)).fillna(0)


def spread(df: DataFrame, records: str, complaints: str, floor: int) -> DataFrame:
    """n, min, median, max of records per complaint among rows with at least `floor` complaints; of no such row 0 and nulls."""
    from .middle import medians

    rows = df.filter(F.col(complaints) >= floor).select((F.col(records) / F.col(complaints)).alias("_ratio"))
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.min("_ratio").alias("low"), F.max("_ratio").alias("high"))
    return ends.join(F.broadcast(medians(rows, [], "_ratio", "middle")), how="left").select("n", "low", "middle", "high")  # a row each


def growth(df: DataFrame, order: str, columns: list[str], where: Column | None = None) -> DataFrame:
    """First and last `order` among the chosen rows and, for each column, the last value over the first."""
    rows = df if where is None else df.filter(where)
    return rows.agg(F.min(order).alias("first"), F.max(order).alias("last"), *[(F.max_by(c, order) / F.nullif(F.min_by(c, order), F.lit(0))).alias(f"{c}_growth") for c in columns])


def peak(df: DataFrame, metric: str, tie: str) -> DataFrame:
    """The whole row with the largest metric; of equal ones the one with the smallest `tie`."""
    return df.orderBy(F.desc(metric), tie).limit(1)


def first_seen(df: DataFrame, group: str, year: str, canonical: list[str]) -> DataFrame:
    """Per canonical group the first year and all years with it, also for groups that never occur."""
    wanted = df.sparkSession.createDataFrame([(g,) for g in canonical], f"{group} string")
    found = df.groupBy(group).agg(F.min(year).alias("first_year"), F.sort_array(F.collect_set(year)).alias("years"))
    return wanted.join(found, group, "left")


def group_table(df: DataFrame, groups: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each group from its total and penal columns: grupo, total, penal, social, pct_penal."""
    sums = df.agg(*[F.sum(c).alias(f"{g}__{k}") for g, pair in groups.items() for k, c in zip(("t", "p"), pair, strict=True)])
    rows = F.array(*[F.struct(F.lit(g).alias("grupo"), F.col(f"{g}__t").alias("total"), F.col(f"{g}__p").alias("penal")) for g in groups])
    return sums.select(F.explode(rows).alias("r")).select("r.*").select("grupo", "total", "penal", (F.col("total") - F.col("penal")).alias("social"), F.when(F.col("total") > 0, F.round(100 * F.col("penal") / F.col("total"), 4)).alias("pct_penal"))


def predominant(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """The most frequent category of each key; of equally frequent ones the first by name."""
    n = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), category)
    return n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
