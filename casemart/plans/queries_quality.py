"""Registered queries: quality, sampling, unions, sheets, files, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, harmonise, sampling
from ..scratch import scratch
from ..sources import files
from ..streaming import ingest
from .proxy import Book, table

BOOK = Book()


@BOOK.add("WITH o AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS s FROM orders) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({e}) AS n_null, count(DISTINCT {e}) AS n_distinct FROM o" for c, e in (("o_orderkey", "o_orderkey"), ("o_custkey", "o_custkey"), ("o_orderstatus", "s"), ("o_totalprice", "o_totalprice"), ("o_orderdate", "o_orderdate"), ("o_orderpriority", "o_orderpriority"))))
def null_profile(spark, sf_dir):
    """All columns of the orders, of which one has nulls."""
    return audit.null_profile(table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))))


@BOOK.add("WITH e AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 3 = 0) SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM e)) AS distinct_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM e)) AS duplicates FROM e")
def distinct_rows(spark, sf_dir):
    """Whole rows of all events, of which a third is there twice."""
    events = table(spark, sf_dir, "events")
    return audit.distinct_rows(events.unionByName(events.filter("event_id % 3 = 0")))


@BOOK.add("""WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status, NULL AS kind, 'orders' AS origin FROM orders UNION ALL SELECT CAST(event_id AS VARCHAR), NULL, event_type, 'events' FROM events)
SELECT origin, status, kind, count(*) AS n, count(DISTINCT key) AS keys FROM o GROUP BY ALL""")
def diagonal_union(spark, sf_dir):
    orders = harmonise.as_strings(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.lit("orders").alias("origin"), F.lit(" ").alias("empty")))
    events = harmonise.as_strings(table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("kind"), F.lit("events").alias("origin"), F.lit("N/D").alias("empty")))
    rows = harmonise.drop_empty(harmonise.union_diagonal([orders, events]))
    one = rows.groupBy(*[c for c in rows.columns if c != "key"], "key").agg(F.count(F.lit(1)).alias("m"))
    return one.groupBy(*[c for c in rows.columns if c != "key"]).agg(F.sum("m").alias("n"), F.count("key").alias("keys"))


@BOOK.add("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), t AS (SELECT sum(n) AS total FROM c), k AS (SELECT event_type, n, greatest(1, round_even(500 * (n / total), 0)) AS k FROM c, t),
a AS (SELECT event_type, CAST(k + CASE WHEN row_number() OVER (ORDER BY n DESC, event_type) = 1 THEN 500 - sum(k) OVER () ELSE 0 END AS BIGINT) AS k FROM k),
r AS (SELECT e.event_id, e.event_type, row_number() OVER (PARTITION BY e.event_type ORDER BY ('0x' || substr(md5('42-' || event_id), 1, 8))::BIGINT, event_id) AS r FROM events e)
SELECT event_id, event_type FROM r JOIN a USING (event_type) WHERE r <= k""")
def stratified_exact_sample(spark, sf_dir):
    return sampling.stratified(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 500)


#: The columns of every table by how both engines write them: plain, numbers with a fraction as millionths, times as microseconds, vectors by their elements.
PRINTED = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_mktsegment c_acctbal/f", "supplier": "s_suppkey s_name s_nationkey s_acctbal/f",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice/f", "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority o_totalprice/f o_orderdate/t",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag l_linestatus l_quantity/f l_extendedprice/f l_discount/f l_tax/f l_shipdate/t",
    "events": "event_id user_id event_type props value/f ts/t", "documents": "doc_id text lang source n_chars", "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text", "embeddings": "vec_id label embedding/v",
}


def _written(column: str, sql: bool):
    """A column of PRINTED, for DuckDB or for Spark."""
    name, _, kind = column.partition("/")
    whole = "CAST(round(CAST({} AS DOUBLE) * 1000000) AS BIGINT)"
    if kind == "v":
        return f"array_to_string(list_transform({name}, lambda x: {whole.format('x')}), ',')" if sql else F.expr(f"array_join(transform({name}, x -> {whole.format('x')}), ',')").alias(name)
    form = {"": "{}", "f": whole, "t": "epoch_us({})" if sql else "unix_micros(CAST({} AS TIMESTAMP))"}[kind].format(name)
    return form if sql else F.expr(form).alias(name)


def _print_sql(t: str) -> str:
    row = "concat_ws('|', " + ", ".join(f"coalesce(CAST({_written(c, True)} AS VARCHAR), '~')" for c in PRINTED[t].split()) + ")"
    code = f"('0x' || substr(md5({row}), 1, 13))::BIGINT"
    return f"SELECT '{t}' AS \"table\", count(*) AS rows, CAST(coalesce(bit_xor({code}), 0) AS BIGINT) AS \"xor\", CAST(coalesce(sum({code} % 2147483647), 0) AS BIGINT) AS \"sum\" FROM {t}"


def _printed(spark, sf_dir, t: str):
    return table(spark, sf_dir, t).select(*[_written(c, False) for c in PRINTED[t].split()])


@BOOK.add(" UNION ALL ".join(map(_print_sql, PRINTED)))
def table_fingerprints(spark, sf_dir):
    """Every table's print over all its columns: rows and order-free sums of row hashes."""
    return harmonise.union_diagonal([audit.fingerprint(_printed(spark, sf_dir, t)).select(F.lit(t).alias("table"), "*") for t in PRINTED])


@BOOK.add(_print_sql("supplier"))
def row_fingerprint(spark, sf_dir):
    """The print of rows is that of the same rows in any order and partitioning."""
    return audit.fingerprint(_printed(spark, sf_dir, "supplier").repartition(5).orderBy(F.desc("s_name"))).select(F.lit("supplier").alias("table"), "*")


@BOOK.add("""WITH b AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(y + 10 AS BIGINT) AS ano, CAST(n AS BIGINT) AS value FROM b WHERE y <> 1997""")
def banded_forward_fill(spark, sf_dir):
    """A sheet made of the orders: a heading for each year, a row for each of three states, totals with marks; one year's total is no number."""
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    marked = F.when(F.col("y") == 1997, "n/d").otherwise(F.format_number("n", 0))
    rows = F.array(
        F.struct((F.col("y") * 10).alias("row"), F.concat(F.lit("Ano "), F.col("y") + 10).alias("label"), F.lit(None).cast("string").alias("total")),
        F.struct((F.col("y") * 10 + 1).alias("row"), F.lit("PR").alias("label"), F.lit("1").alias("total")),
        F.struct((F.col("y") * 10 + 2).alias("row"), F.lit(" sc ").alias("label"), marked.alias("total")),
    )
    return files.banded(years.select(F.explode(rows).alias("r")).select("r.*"), "label", "total", "row")


_CSV_SEGMENT = "CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN '\"' || c_mktsegment || '\"' ELSE c_mktsegment || ' é' END"


@BOOK.add(f"SELECT CAST(c_custkey AS VARCHAR) AS codigo, c_name AS nome, {_CSV_SEGMENT} AS segmento, CASE WHEN c_custkey % 9 <> 0 AND c_custkey % 4 <> 0 THEN 'São ' || c_nationkey END AS lugar FROM customer")
def csv_round_trip(spark, sf_dir):
    """Customers as a Latin-1 file with semicolons, quotes that are data, short and long rows and null words; all is detected, converted to Parquet and compared, and the copy is read."""
    csv, out = scratch(spark, "round-csv"), scratch(spark, "round-parquet")
    k = F.col("c_custkey")
    segment = F.when(k % 5 == 0, "N/D").when(k % 3 == 0, F.concat(F.lit('"'), "c_mktsegment", F.lit('"'))).otherwise(F.concat("c_mktsegment", F.lit(" é")))
    place = F.when(k % 4 == 0, "None").otherwise(F.concat(F.lit("São "), F.col("c_nationkey")))
    line = F.when(k % 9 == 0, F.concat_ws(";", k, "c_name")).otherwise(F.concat_ws(";", k, "c_name", segment, place, F.when(k % 7 == 0, "one field too many")))
    lines = table(spark, sf_dir, "customer").select(F.lit(1).alias("nth"), line.alias("value")).unionByName(spark.createDataFrame([(0, "codigo;nome;segmento;lugar")], "nth int, value string"))
    lines.repartition(1).sortWithinPartitions("nth").select("value").write.option("encoding", "ISO-8859-1").text(csv)
    files.csv_to_parquet(spark, csv, out)
    return spark.read.parquet(out)


@BOOK.add("""SELECT 'source' AS side, CAST(1 AS BIGINT) AS times, l_orderkey, l_linenumber, l_quantity, count(*) AS rows FROM lineitem WHERE l_orderkey % 97 = 5 AND l_linenumber = 1 GROUP BY ALL
UNION ALL SELECT 'copy', 1, l_orderkey, l_linenumber, l_quantity + 1, count(*) FROM lineitem WHERE l_orderkey % 97 = 5 AND l_linenumber = 1 GROUP BY ALL""")
def copy_differences(spark, sf_dir):
    """All lines against a copy in which some quantities were changed: the rows that either side has and the other lacks."""
    lines = table(spark, sf_dir, "lineitem")
    hit = F.expr("l_orderkey % 97 = 5 AND l_linenumber = 1")
    copy = lines.withColumn("l_quantity", F.when(hit, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    report, found = audit.compare(lines, copy)
    assert {r.check for r in report.filter("not passed").collect()} <= {"content", "column l_quantity"}
    odd = audit.differing(lines, copy, found)
    return odd.groupBy("side", "times", "l_orderkey", "l_linenumber", "l_quantity").agg(F.count(F.lit(1)).alias("rows"))


@BOOK.add("SELECT 'o_orderstatus=' || o_orderstatus AS folder, CASE o_orderstatus WHEN 'F' THEN 'diverge' WHEN 'O' THEN 'absent' ELSE 'match' END AS status FROM orders GROUP BY o_orderstatus")
def artefact_check(spark, sf_dir):
    """Files of a partitioned write against the prints of an earlier one, in which one folder was damaged and one taken away since."""
    out = scratch(spark, "artefacts")
    files.write_parquet(table(spark, sf_dir, "orders"), out, ["o_orderstatus"])
    prints = audit.file_fingerprints(spark, f"{out}/o_orderstatus=*", parts=2).persist()
    prints.count()
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(out)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jvm.org.apache.hadoop.fs.Path(root, "o_orderstatus=O"), True)
    for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "o_orderstatus=F/part-*")):
        stream = fs.append(found.getPath()) if fs.getScheme() != "file" else fs.create(found.getPath(), True)
        stream.write(0)
        stream.close()
    said = audit.file_fingerprints(spark, f"{out}/o_orderstatus=*", prints, parts=2)
    return said.groupBy(F.substring_index("file", "/", 1).alias("folder")).agg(F.min("status").alias("status")).filter("status is not null")


@BOOK.add("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def incremental_ingest(spark, sf_dir):
    """Events land as files in two goes; a stream takes up each file once; the result equals the batch."""
    source, out, log = scratch(spark, "landing"), scratch(spark, "landed"), scratch(spark, "landing-log")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (0, 1):
        events.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(source)
        ingest.land(spark, source, events.schema, lambda d: d.filter("event_id is not null"), out, log).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@BOOK.add("SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS from_time, count(*) AS records, count(DISTINCT user_id) AS ids FROM events GROUP BY 1")
def running_kpi(spark, sf_dir):
    """The weeks of a whole table: ids are counted by week and id first, then by week, so a hot week lies in no single task."""
    week = F.window(F.col("ts").cast("timestamp"), "7 days").start.cast("timestamp_ntz").alias("from_time")
    one = table(spark, sf_dir, "events").groupBy(week, "user_id").agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("from_time").agg(F.sum("n").alias("records"), F.count("user_id").alias("ids"))


@BOOK.add("SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS from_time, count(*) AS records, count(DISTINCT user_id) AS ids FROM events GROUP BY 1")
def running_kpi_stream(spark, sf_dir):
    """The same as a stream in two goes: state by week and id is kept between the runs, update mode hands on what changed, and the last word on each counts."""
    source, out, log = scratch(spark, "kpi-landing"), scratch(spark, "kpi-updates"), scratch(spark, "kpi-log")
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    for part in (0, 1):
        events.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(source)
        ingest.run_kpi(spark, source, events.schema, "ts", "7 days", "400 days", "user_id", out, log).awaitTermination()
    return ingest.latest(spark.read.parquet(out)).select(F.col("from_time").cast("timestamp_ntz").alias("from_time"), "records", "ids")


@BOOK.add("SELECT time_bucket(INTERVAL 2 DAY, ts, TIMESTAMP '1970-01-01') AS from_time, count(*) AS records, count(DISTINCT user_id) AS ids FROM events GROUP BY 1 HAVING from_time + INTERVAL 2 DAY <= (SELECT max(ts) - INTERVAL 3 DAY FROM events)")
def closed_kpi_stream(spark, sf_dir):
    """Windows of two days, each written once when the events have gone three days past it; the events come in two goes by time."""
    source, out, log = scratch(spark, "closed-landing"), scratch(spark, "closed"), scratch(spark, "closed-log")
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    first = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    for some in (first, ~first):
        events.filter(some).write.mode("append").parquet(source)
        ingest.closed_kpi(spark, source, events.schema, "ts", "2 days", "3 days", "user_id", out, log).awaitTermination()
    return spark.read.parquet(out).select(F.col("from_time").cast("timestamp_ntz").alias("from_time"), "records", "ids")
