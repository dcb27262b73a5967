"""Registered queries: complaints of several periods and places counted once, from stored tables alone.

Lines are records and customers complaints, so a complaint has records in many
years, and with the supplier's nation as place also in many places.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mergeable
from ..scratch import scratch
from .proxy import Book, table

BOOK = Book()
KEYS = ["place", "ano", "semestre"]
RECORDS = """WITH rec AS (SELECT s_nationkey AS place, n_regionkey AS region, CAST(year(o_orderdate) AS BIGINT) AS ano, CAST(CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS BIGINT) AS semestre,
  o_custkey AS id, o_orderstatus <> 'P' AS reliable, l_returnflag = 'R' AS penal FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
per AS (SELECT id, {by}, count(*) AS n, count_if(penal) AS p FROM {rows} WHERE reliable GROUP BY ALL) SELECT {by}, count(*) AS denuncias_unicas, count_if(p > 0) AS denuncias_unicas_penal, count_if(p * 2 > n) AS denuncias_unicas_maioria_penal{more} FROM per GROUP BY {by}"""


def records(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.col("s_nationkey").alias("place"), F.year("o_orderdate").cast("long").alias("ano"), F.when(F.month("o_orderdate") <= 6, 1).otherwise(2).cast("long").alias("semestre"),
        F.col("o_custkey").alias("id"), (F.col("o_orderstatus") != "P").alias("reliable"), (F.col("l_returnflag") == "R").alias("penal"),
    )


def stored_tables(spark, sf_dir):
    return mergeable.save(mergeable.complaint_tables(records(spark, sf_dir), KEYS, "id", F.col("reliable"), F.col("penal")), scratch(spark, "complaints"))


@BOOK.add(RECORDS.format(by="until, place", rows="(SELECT rec.*, u.until FROM rec JOIN (SELECT unnest([1996, 1998, 2001]) AS until) u ON ano BETWEEN until - 2 AND until)", more=""))
def complaints_any_years(spark, sf_dir):
    """Three spans of up to three years by place: a complaint counts once in each, whatever it has in how many halves."""
    tables = stored_tables(spark, sf_dir)
    spans = [mergeable.merged(tables, ["place"], F.col("ano").between(until - 2, until)).withColumn("until", F.lit(until)) for until in (1996, 1998, 2001)]
    return spans[0].unionByName(spans[1]).unionByName(spans[2])


@BOOK.add(RECORDS.format(by="region", rows="(SELECT * FROM rec WHERE semestre = 2)", more=", true AS near, true AS near_penal"))
def complaints_by_region(spark, sf_dir):
    """Places merged to regions over all second halves, exactly, and the sketch's estimates within five standard errors of that."""
    tables = stored_tables(spark, sf_dir)
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_regionkey").alias("region"))
    placed = tables._replace(**{name: getattr(tables, name).join(nations, "place") for name in ("bits", "by_key", "several")})
    rows = mergeable.merged(placed, ["region"], F.col("semestre") == 2, sketched=True)
    error = 5 * 1.04 / 2 ** (mergeable.SKETCH / 2)
    near = {"near": ("estimate", "denuncias_unicas"), "near_penal": ("estimate_penal", "denuncias_unicas_penal")}
    return rows.withColumns({n: F.abs(F.col(e) - F.col(c)) <= F.greatest(F.lit(1.0), F.col(c) * error) for n, (e, c) in near.items()}).drop("estimate", "estimate_penal")


@BOOK.add(RECORDS.format(by="x", rows="(SELECT *, 0 AS x FROM rec WHERE place % 3 = 1 AND ano <> 1997)", more="").replace("SELECT x, count", "SELECT count").replace(" GROUP BY x", ""))
def complaints_of_choice(spark, sf_dir):
    """Some places and all years but one, as one number each."""
    return mergeable.merged(stored_tables(spark, sf_dir), [], (F.col("place") % 3 == 1) & (F.col("ano") != 1997))
