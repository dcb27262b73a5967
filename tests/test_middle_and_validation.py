import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from casemart.operators import aggregate, audit, middle


@pytest.mark.parametrize(("most", "buckets"), [(20, 16), (50_000, 1_024)])
def test_medians(spark, monkeypatch, most, buckets):
    monkeypatch.setattr(middle, "BUCKETS", buckets)
    rng, rows = random.Random(1), []
    for key, n, draw in (("odd", 301, lambda: rng.gauss(0, 1e9)), ("even", 300, lambda: rng.random()), ("ties", 200, lambda: rng.choice([1.0, 1.0, 2.0])), ("same", 90, lambda: 7.5), ("wide", 150, lambda: 10 ** rng.uniform(-300, 300) * rng.choice([1, -1])), ("one", 1, lambda: 3.0), (None, 40, lambda: rng.randint(-9, 9) * 1.0)):
        rows += [(key, k % 2, draw()) for k in range(n)]
    rows += [("two", 0, 1.0), ("two", 0, 4.0), ("empty", 0, None), ("odd", 0, None), ("nan", 0, float("nan")), ("ends", 0, float("inf")), ("ends", 0, float("-inf")), ("ends", 0, 2.0)]
    df = spark.createDataFrame(rows, "k string, h int, v double").repartition(4)
    for keys in (["k"], ["k", "h"], []) if most > 20 else (["k"],):
        want = defaultdict(list)
        for k, h, v in rows:
            if v is not None and v == v:
                want[tuple({"k": k, "h": h}[c] for c in keys)].append(v)
        got = {tuple(r)[:-1]: r.m for r in middle.medians(df, keys, "v", "m", most).collect()}
        assert got.keys() == want.keys()
        for key, values in want.items():
            values = sorted(values)
            assert got[key] == values[(len(values) - 1) // 2] * 0.5 + values[len(values) // 2] * 0.5, key


def test_spread_of_few_and_none(spark):
    df = spark.createDataFrame([(10, 2), (9, 3), (8, 8), (50, 1)], "r long, c long")
    assert tuple(aggregate.spread(df, "r", "c", 2).first()) == (3, 1.0, 3.0, 5.0)
    assert tuple(aggregate.spread(df, "r", "c", 100).first()) == (0, None, None, None)
    assert statistics.median([5.0, 3.0, 1.0]) == 3.0


SCHEMA = "k long, v string, t timestamp, `odd name` double"


def failed(a, b):
    return {r.check for r in audit.validate_copy(a, b).filter("not passed").collect()}


def test_validation_in_one_pass(spark):
    rows = [(k, None if k % 5 == 0 else f"v{k}", None, k / 7) for k in range(50)]
    a = spark.createDataFrame(rows, SCHEMA)
    assert failed(a, a.repartition(3)) == set()
    lost = spark.createDataFrame(rows[1:], SCHEMA)
    assert failed(a, lost) == {"rows", "content", "column k", "column v", "column t", "column odd name"}
    swapped = [(rows[1][0], rows[2][1], None, rows[1][3]), (rows[2][0], rows[1][1], None, rows[2][3])]
    # two values change places: rows differ, but no column does
    assert failed(a, spark.createDataFrame([rows[0], *swapped, *rows[3:]], SCHEMA)) == {"content"}
    again = spark.createDataFrame([*rows[:-1], rows[3]], SCHEMA)
    assert failed(a, again) == {"content", "column k", "column v", "column odd name"}
    odd = {(r.side, r.times, r.k) for r in audit.differing(a, again).collect()}
    assert odd == {("source", 1, 49), ("copy", 1, 3)}
    assert failed(a, a.withColumnRenamed("v", "w")) == {"columns"}


def test_empty_text_is_not_null_and_a_microsecond_is_seen(spark):
    a = spark.sql("SELECT 1 AS k, '' AS v, timestamp'2024-01-01 00:00:00.000001' AS t")
    assert failed(a, spark.sql("SELECT 1 AS k, CAST(NULL AS STRING) AS v, timestamp'2024-01-01 00:00:00.000001' AS t")) == {"content", "column v"}
    assert failed(a, spark.sql("SELECT 1 AS k, '' AS v, timestamp'2024-01-01 00:00:00.000002' AS t")) == {"content", "column t"}


def test_each_side_is_read_once(spark, tmp_path):
    spark.range(20).write.parquet(f"{tmp_path}/a")
    spark.range(20).write.parquet(f"{tmp_path}/b")
    plan = audit.signed_rows(spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2


def test_rows_that_do_not_differ_stay_in_their_tasks(spark, tmp_path, monkeypatch):
    """What the tasks hand on: sums by bucket, then rows of the buckets and rows that differ, and no others."""

    def handed_on():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    monkeypatch.setattr(audit, "BUCKETS", 1 << 12, raising=False)
    spark.range(200_000).selectExpr("id", "concat('v', id) AS v", "id % 7 AS seven").write.parquet(f"{tmp_path}/a")
    a = spark.read.parquet(f"{tmp_path}/a")
    b = a.withColumn("v", F.when(F.expr("id % 50000 = 3"), "other").otherwise(F.col("v")))
    before = handed_on()
    assert failed(a, b) == {"content", "column v"}
    found = {(r.side, r.times, r.id, r.v) for r in audit.differing(a, b).collect()}
    assert found == {(side, 1, i, f"v{i}" if side == "source" else "other") for i in range(3, 200_000, 50_000) for side in ("source", "copy")}
    assert handed_on() - before < 3_000_000


def test_buckets_tell_counts_nulls_and_places_of_values(spark):
    def same(a, b):
        return audit.bucket_sums(*(spark.createDataFrame(x, "k string, v string") for x in (a, b))).filter("not same").isEmpty()

    assert same([("a", None), ("b", "c")], [("b", "c"), ("a", None)])
    for other in ([(None, "a"), ("b", "c")], [("a", None), ("c", "b")], [("a", ""), ("b", "c")], [("a", None), ("b", "c"), ("b", "c")], [("a", None), ("a", None)], [("a", None), ("bc", "")], []):
        assert not same([("a", None), ("b", "c")], other)
