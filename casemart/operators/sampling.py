"""Exact-size stratified sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Strata that a plan on the driver may have.
MOST_STRATA = 100_000


def allocation(counts: dict[str, int], size: int) -> dict[str, int]:
    """Rows of each stratum: in proportion, at least one, the remainder to the largest (of equal ones the first by name).

    With more strata than rows the largest strata get one row each. Never more
    than `size` in all, nor than a stratum has.
    """
    by_size = sorted(counts, key=lambda s: (-counts[s], str(s)))
    if len(counts) >= size:
        return {s: int(n < size) for n, s in enumerate(by_size)}
    total = sum(counts.values())
    share = {s: max(1, round(size * n / total)) for s, n in counts.items()}
    share[by_size[0]] += size - sum(share.values())
    for s in by_size[1:]:  # what "at least one" took beyond the largest stratum's share
        if share[by_size[0]] >= 1:
            break
        taken = min(share[s] - 1, 1 - share[by_size[0]])
        share[s] -= taken
        share[by_size[0]] += taken
    return {s: min(k, counts[s]) for s, k in share.items()}


def stratified(df: DataFrame, stratum: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """`size` rows in proportion to the strata, chosen by a seeded MD5 of the key.

    Only each stratum's smallest hashes are ranked: a hash bound leaves about
    twice the rows wanted, so a stratum with most rows is never sorted whole.
    Where the bound leaves too few, all of the stratum's rows are ranked. The
    strata themselves come to the driver, one count each, MOST_STRATA at most.
    """
    counts = {r[0]: r[1] for r in df.groupBy(stratum).agg(F.count(F.lit(1))).limit(MOST_STRATA + 1).collect()}
    if len(counts) > MOST_STRATA:
        raise ValueError(f"more than {MOST_STRATA} strata")
    if not counts:
        return df
    want = allocation(counts, size)
    spark = df.sparkSession
    code = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    rows = df.withColumn("_code", code)
    bound = {s: min(1 << 32, int((2 * k + 64) / counts[s] * (1 << 32))) for s, k in want.items()}
    plan = spark.createDataFrame([(s, k, bound[s]) for s, k in want.items()], f"_s {df.schema[stratum].dataType.simpleString()}, _k long, _b long")
    near = rows.join(F.broadcast(plan), F.col(stratum).eqNullSafe(F.col("_s"))).filter("_code < _b")
    enough = {r[0]: r[1] for r in near.groupBy(stratum).agg(F.count(F.lit(1))).collect()}
    short = [s for s, k in want.items() if enough.get(s, 0) < k]
    if short:
        plan = spark.createDataFrame([(s, k, (1 << 32) if s in short else bound[s]) for s, k in want.items()], plan.schema)
        near = rows.join(F.broadcast(plan), F.col(stratum).eqNullSafe(F.col("_s"))).filter("_code < _b")
    w = Window.partitionBy(stratum).orderBy("_code", key)
    return near.withColumn("_r", F.row_number().over(w)).filter("_r <= _k").select(*df.columns)
