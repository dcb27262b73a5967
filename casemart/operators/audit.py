"""Data quality: validation, fingerprints, inventory, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from .harmonise import quoted

#: Buckets whose sums tell where rows differ: so many rows at most leave a task before it is known, and so many numbers are sent to all tasks.
BUCKETS = 1 << 20


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that says the same for the same rows in any order: rows, and two sums of 52 bits of the rows' MD5, which other engines have too."""
    text = F.concat_ws("|", *[F.coalesce(quoted(c).cast("string"), F.lit("~")) for c in df.columns])
    rows = df.select(F.conv(F.substring(F.md5(F.encode(text, "utf-8")), 1, 13), 16, 10).cast("long").alias("_code"))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor("_code"), F.lit(0).cast("long")).alias("xor"), F.coalesce(F.sum(F.col("_code") % (2**31 - 1)), F.lit(0).cast("long")).alias("sum"))


def _prints(df: DataFrame, columns: list[str], sign: int) -> DataFrame:
    """The MD5 of each row over all its values, +1 or -1, and a number for each value."""
    text = {c: quoted(c).cast("string") for c in columns}
    row = F.md5(F.to_json(F.struct(*[v.alias(f"c{i}") for i, v in enumerate(text.values())])))
    return df.select(row.alias("_row"), F.lit(sign).alias("_sign"), *[F.xxhash64(v).alias(f"_h{i}") for i, v in enumerate(text.values())])


def signed_rows(source: DataFrame, copy: DataFrame) -> DataFrame:
    """For each different row of two frames with the same columns: its print, its rows on either side, and the surplus of the source. Each side is read once."""
    columns = source.columns
    both = _prints(source, columns, 1).unionByName(_prints(copy, columns, -1))
    return both.groupBy("_row").agg(
        F.count_if(F.col("_sign") > 0).alias("_in_source"), F.count_if(F.col("_sign") < 0).alias("_in_copy"), F.sum("_sign").alias("_surplus"), *[F.first(f"_h{i}").alias(f"_h{i}") for i in range(len(columns))]
    )


def _bucketed(df: DataFrame) -> DataFrame:
    """`df` with two independent numbers of each row's values, as they are written, and a bucket by either."""
    text = [quoted(c).cast("string") for c in df.columns]
    # a null leaves such a number as it is, so which values are null is a value too
    nulls = F.concat(F.lit(""), *[quoted(c).isNull().cast("int").cast("string") for c in df.columns])
    return df.withColumns({"_one": F.xxhash64(*text, nulls), "_two": F.xxhash64(F.lit(1), *text, nulls)}).withColumns({f"_bucket{n}": F.col(n).bitwiseAND(F.lit(BUCKETS - 1)) for n in ("_one", "_two")})


def bucket_sums(source: DataFrame, copy: DataFrame) -> DataFrame:
    """bucket, its rows on either side, and whether it holds the same rows on both: by sums of 96 bits of the rows' numbers. Each side is read once, tasks hand on sums alone."""
    sides = [_bucketed(df).select(F.col("_bucket_one").alias("bucket"), "_one", "_two", F.lit(sign).alias("_sign")) for df, sign in ((source, 1), (copy, -1))]
    high, low = (lambda c: F.shiftrightunsigned(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1)))
    sums = {"a": high("_one"), "b": low("_two"), "c": high("_two")}
    per = sides[0].unionByName(sides[1]).groupBy("bucket").agg(F.count_if(F.col("_sign") > 0).alias("in_source"), F.count_if(F.col("_sign") < 0).alias("in_copy"), *[F.sum(v * F.col("_sign")).alias(n) for n, v in sums.items()])
    return per.select("bucket", "in_source", "in_copy", F.expr("in_source = in_copy and a = 0 and b = 0 and c = 0").alias("same"))


def _print(columns: list[str]) -> Column:
    """The MD5 of a row over all its values."""
    return F.unhex(F.md5(F.to_json(F.struct(*[quoted(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]))))


def surplus(source: DataFrame, copy: DataFrame, sums: DataFrame) -> DataFrame:
    """_row, _surplus, _bucket_one, _bucket_two of the rows that one side has more often (over 0: the source); only rows of buckets that differ leave their tasks."""
    odd = F.broadcast(sums.filter("not same").select(F.col("bucket").alias("_bucket_one")))
    keys = ["_row", "_bucket_one", "_bucket_two"]
    sides = [_bucketed(df).join(odd, "_bucket_one", "left_semi").select(_print(df.columns).alias("_row"), *keys[1:], F.lit(sign).alias("_sign")) for df, sign in ((source, 1), (copy, -1))]
    return sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.sum("_sign").alias("_surplus")).filter("_surplus <> 0")


def differing(source: DataFrame, copy: DataFrame, odd: DataFrame | None = None) -> DataFrame:
    """The rows themselves that one side has more often: side, times, and all columns. Only asked for when a validation has failed, whose `surplus` may be given."""
    if odd is None:
        odd = stored(surplus(source, copy, stored(bucket_sums(source, copy), "audit-buckets")), "audit-surplus")
    frames = []
    for side, df, sign in (("source", source, 1), ("copy", copy, -1)):
        mine, rows = odd.filter(F.col("_surplus") * sign > 0), _bucketed(df)
        # few rows have both of their buckets among those of rows that differ
        for bucket in ("_bucket_one", "_bucket_two"):
            rows = rows.join(F.broadcast(mine.select(bucket).distinct()), bucket, "left_semi")
        rows = rows.select(_print(df.columns).alias("_print"), *map(quoted, df.columns)).dropDuplicates(["_print"]).join(mine, F.col("_print") == F.col("_row"))
        frames.append(rows.select(F.lit(side).alias("side"), (F.col("_surplus") * sign).alias("times"), *map(quoted, df.columns)))
    return frames[0].unionByName(frames[1])


def validate_copy(source: DataFrame, copy: DataFrame) -> DataFrame:
    """check, passed, detail: names and order of columns, number of rows, rows that only one side has, and, where rows differ, each column by its values in any order.

    Every row is compared, none sampled: see `compare`, which also has the rows
    that differ. Raise on a failed check with `require`.
    """
    return compare(source, copy)[0]


def compare(source: DataFrame, copy: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The report of `validate_copy`, and the `surplus` if rows differ.

    One pass over each side sums the rows by bucket, +1 for the source and -1
    for the copy; where all sums cancel no row differs. Otherwise rows of the
    buckets left are summed by their print, and values of each column by their
    numbers, over all rows: what both sides have cancels.
    """
    spark = source.sparkSession
    schema = "check string, passed boolean, detail string"
    checks = [("columns", source.columns == copy.columns, str([c for c in source.columns if c not in copy.columns]))]
    if source.columns != copy.columns:
        n, m = source.count(), copy.count()
        return spark.createDataFrame([*checks, ("rows", n == m, f"{n} and {m}")], schema), None
    zero, odd = F.lit(0), None
    sums = stored(bucket_sums(source, copy), "audit-buckets")
    s = sums.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("in_source", "in_copy")], F.count_if(~F.col("same")).alias("odd")).first()
    more = less = 0
    if s.odd:
        odd = stored(surplus(source, copy, sums), "audit-surplus")
        more, less = odd.agg(*[F.coalesce(F.sum(F.greatest(F.col("_surplus") * sign, zero)), zero) for sign in (1, -1)]).first()
    checks += [("rows", s.in_source == s.in_copy, f"{s.in_source} and {s.in_copy}"), ("content", not (more or less), f"{more} only in the source, {less} only in the copy")]
    if more or less:
        numbers = [df.select(*[(F.xxhash64(quoted(c).cast("string")).cast("decimal(20,0)") * sign).alias(f"c{i}") for i, c in enumerate(df.columns)]) for df, sign in ((source, 1), (copy, -1))]
        both = numbers[0].unionByName(numbers[1])
        left = both.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in both.columns]).first()
        checks += [(f"column {c}", not left[f"c{i}"], "") for i, c in enumerate(source.columns)]
    return spark.createDataFrame(checks, schema), odd


def require(report: DataFrame) -> None:
    failed = report.filter("not passed").collect()
    if failed:
        raise ValueError("; ".join(f"{r.check}: {r.detail}" for r in failed))


def distinct_rows(df: DataFrame) -> DataFrame:
    """rows, distinct_rows, duplicates over all columns."""
    per = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows")).withColumn("duplicates", F.col("rows") - F.col("distinct_rows"))


def null_profile(df: DataFrame) -> DataFrame:
    """column_name, n_rows, n_null, n_distinct for every column (distinct as SQL counts it, without null)."""
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(quoted(c)).alias(f"f{i}") for i, c in enumerate(df.columns)])
    for i, c in enumerate(df.columns):  # a count for each column: several distinct counts in one pass would multiply the rows
        one = df.select(quoted(c).alias("v")).distinct().agg(F.count("v").alias(f"d{i}"))
        sums = sums.crossJoin(one)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"f{i}")).alias("n_null"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(df.columns)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def reconcile(**totals: DataFrame) -> DataFrame:
    """path, records, penal, equal: totals by several paths, each a frame of one row with records and penal, against the first."""
    frames = [t.select(F.lit(n).alias("path"), "records", "penal") for n, t in totals.items()]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    want = frames[0].select(F.col("records").alias("_r"), F.col("penal").alias("_p"))
    return rows.crossJoin(F.broadcast(want)).select("path", "records", "penal", ((F.col("records") == F.col("_r")) & (F.col("penal") == F.col("_p"))).alias("equal"))


def file_fingerprints(spark, path: str, expected: DataFrame | None = None, parts: int = 1) -> DataFrame:
    """file (the last `parts` of its path), sha256 of every file at a path; with `expected` (file, sha256) also match, diverge or absent."""
    found = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -parts).alias("file"), F.sha2("content", 256).alias("sha256"))
    if expected is None:
        return found
    want = expected.select("file", F.col("sha256").alias("expected"))
    status = F.when(F.col("sha256").isNull(), "absent").when(F.col("sha256") == F.col("expected"), "match").otherwise("diverge")
    return want.join(found, "file", "left").withColumn("status", status)


def overlap(df: DataFrame, flags: list[str]) -> DataFrame:
    """Rows in no group, in one, in several, and the sum over groups against the rows."""
    n = sum((F.col(f) for f in flags[1:]), F.col(flags[0]))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(n == 0).alias("none"), F.count_if(n == 1).alias("one"), F.count_if(n >= 2).alias("several"), F.sum(n).alias("sum_of_groups"))


def against_official(own: DataFrame, official: DataFrame, year: str = "ano", how: str = "inner") -> DataFrame:
    """Own totals beside official ones by year, with their ratio."""
    return official.join(own, year, how).withColumn("ratio", F.when(F.col("official") > 0, F.round(F.col("own") / F.col("official"), 4)))
