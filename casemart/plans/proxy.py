"""The case model over the order tables: lines are records, orders are complaints, nations are territories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Book:
    """Queries by name, and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The six group flags as predicates of an order line.
FLAGS = {
    "is_crianca": "p_size <= 10",
    "is_mulher": "p_type IN ('ECONOMY', 'PROMO')",
    "is_idoso": "p_size >= 45",
    "is_pcd": "l_discount >= 0.09",
    "is_lgbtqia": "c_mktsegment = 'BUILDING'",
    "is_prisional_rua": "o_orderpriority = '1-URGENT'",
}
FACT_COLUMNS = f"""l_orderkey AS id, n_nationkey AS territory, n_name AS territory_name, n_regionkey AS region,
  CAST(year(o_orderdate) AS BIGINT) AS ano, CAST(CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS BIGINT) AS semestre,
  o_orderstatus <> 'P' AS reliable, l_returnflag = 'R' AS penal, l_returnflag AS degree, o_orderdate, p_type, p_brand, p_size, l_quantity, o_custkey,
  {", ".join(f"CAST(CASE WHEN {e} THEN 1 ELSE 0 END AS BIGINT) AS {n}" for n, e in FLAGS.items())}"""
FACT_FROM = """lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey"""
#: The start of an oracle over the fact.
FACT = f"WITH fact AS (SELECT {FACT_COLUMNS} FROM {FACT_FROM}) "
#: Population of a territory: a thousand for each customer; one territory has none, as in a dimension with a gap.
POPULATION = "pop AS (SELECT c_nationkey AS territory, CAST(CASE WHEN c_nationkey = 3 THEN NULL ELSE count(*) * 1000 END AS BIGINT) AS population FROM customer GROUP BY c_nationkey)"


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classified records. Dimensions are joined as they are: Spark broadcasts those that are small."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_discount", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
    )
    return joined.select(
        F.col("l_orderkey").alias("id"), F.col("n_nationkey").alias("territory"), F.col("n_name").alias("territory_name"), F.col("n_regionkey").alias("region"),
        F.year("o_orderdate").cast("long").alias("ano"), F.when(F.month("o_orderdate") <= 6, 1).otherwise(2).cast("long").alias("semestre"),
        (F.col("o_orderstatus") != "P").alias("reliable"), (F.col("l_returnflag") == "R").alias("penal"), F.col("l_returnflag").alias("degree"), "o_orderdate", "p_type", "p_brand", "p_size", "l_quantity", "o_custkey",
        *[F.expr(e).cast("long").alias(n) for n, e in FLAGS.items()],
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("territory")).agg((F.count(F.lit(1)) * 1000).alias("population"))
    return counts.withColumn("population", F.when(F.col("territory") != 3, F.col("population")))
