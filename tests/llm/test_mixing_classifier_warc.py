import gzip
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from casemart.llm import classifier, mixing, warc_audit
from casemart.llm.common import scratch


def corpus(spark):
    return spark.range(3000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40 + 1).cast("int")).alias("text"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").otherwise("tiny").alias("source")
    )


def entropy(w):
    return -sum(x * math.log(x) for x in w if x > 0)


def test_weights_meet_the_entropy(spark):
    got = mixing.mix(corpus(spark), target_entropy=0.95, repeat_limit=20.0).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    total = sum(r.n for r in got)
    assert entropy([r.n / total for r in got]) == pytest.approx(0.95 * math.log(3), abs=0.01)
    assert total == pytest.approx(corpus(spark).select(F.sum(mixing.tokens(F.col("text")))).first()[0], rel=0.01)


def test_repetition_limit_wins(spark):
    rows = mixing.mix(corpus(spark), target_entropy=1.0, repeat_limit=2.0)
    n = {r.source: r.n for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    have = {r.source: r.n for r in corpus(spark).groupBy("source").agg(F.sum(mixing.tokens(F.col("text"))).alias("n")).collect()}
    assert n["tiny"] / have["tiny"] == pytest.approx(2.0, abs=0.05)
    assert rows.agg(F.max("epoch")).first()[0] <= 2


def test_cover_loses_no_document(spark):
    rows = mixing.mix(corpus(spark), target_entropy=0.95, cover=True)
    assert rows.select("doc_id").distinct().count() == 3000
    assert mixing.mixed_rows(corpus(spark), target_entropy=0.95, cover=True).count() == rows.count()


@pytest.mark.parametrize("limit", [1.3, 2.0])
def test_the_limit_holds_with_cover(spark, limit):
    """The budget that cover raises is the one that the limit is bisected against."""
    have = {r.source: r.n for r in corpus(spark).groupBy("source").agg(F.sum(mixing.tokens(F.col("text"))).alias("n")).collect()}
    rows = mixing.mix(corpus(spark), target_entropy=1.0, repeat_limit=limit, cover=True)
    n = {r.source: r.n for r in rows.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert max(n[s] / have[s] for s in have) == pytest.approx(limit, abs=0.02)
    assert rows.select("doc_id").distinct().count() == 3000


def test_the_sql_has_the_limit(spark, tmp_path):
    """A source so small that the limit binds: query and SQL still agree."""
    import duckdb

    docs = spark.range(2000).select("id", F.repeat(F.lit("w "), (F.col("id") % 40 + 1).cast("int")).alias("text"), F.when(F.col("id") == 0, "one").when(F.col("id") % 50 == 1, "few").otherwise("big").alias("source")).withColumnRenamed("id", "doc_id")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, mixing.op3_mixing(spark, str(tmp_path)).collect()))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert sorted(db.execute(mixing.OP3_SQL).fetchall()) == got
    times = {}
    for r in got:
        times[r[1]] = times.get(r[1], 0) + r[2]
    assert times["few"] > 900 and times["one"] <= 4


def test_every_pass_takes_a_block_once(spark):
    rows = mixing.mix(corpus(spark), target_entropy=0.99)
    assert rows.count() == rows.select("doc_id", "epoch").distinct().count()
    assert rows.filter("turn < 0 or turn > 1000000").isEmpty()


def test_mixing_awkward_rows(messy, rows, nothing):
    got = mixing.mixed_rows(messy, cover=True)
    assert got.columns == messy.columns and got.count() >= len(rows)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_rows(nothing, cover=True).count() == 0


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = classifier.fit(docs, labels)
    got = classifier.scored(docs, model).join(labels, "doc_id").filter(classifier.in_fold(F.col("doc_id")))
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.95
    assert model == classifier.fit(docs.repartition(5), labels.repartition(2))


def test_classifier_awkward_rows(spark, messy, rows, nothing):
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(None, 1), (3, None)], "doc_id long, quality int")
    for some in (labels, labels.filter("quality = 1"), labels.limit(0)):
        got = classifier.scored(messy, classifier.fit(messy, some)).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert classifier.scored(nothing, classifier.fit(nothing, labels)).count() == 0


PAGES = [(1, "http://a", "<p>one</p>"), (2, None, None), (3, "http://c\r\nX: y", "two\r\n\r\nparts"), (4, "u", "holds\r\n\r\nWARC/1.1\r\nWARC-Type: fake"), (5, "u", ""), (5, "u", ""), (None, "n", "é 日本")]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = scratch(spark, "test-warc")
    warc_audit.write_replica(pages, path, segments=2)
    got = warc_audit.read_replica(spark, path).collect()
    assert sorted((str(r.page_id), r.body) for r in got) == sorted((str(i), h or "") for i, _, h in PAGES)
    assert all(r.intact for r in got)


def test_audit_finds_exactly_the_damage(spark):
    pages = spark.range(700).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.repeat(F.lit("body "), (F.col("id") % 50).cast("int")).alias("html"))
    a, b = scratch(spark, "test-warc"), scratch(spark, "test-warc")
    warc_audit.write_replica(pages, a, segments=3)
    warc_audit.write_replica(pages, b, segments=3, body=F.when(F.col("page_id") == 123, "other").otherwise(F.col("html")), keep=~F.col("page_id").isin(7, 600))
    got = {r.page_id: r for r in warc_audit.audit(spark, a, b).collect()}
    assert len(got) == 700
    assert {k: r.status for k, r in got.items() if r.status != "ok"} == {7: "missing_in_b", 600: "missing_in_b", 123: "corrupt"}
    assert all(r.status == "ok" for r in warc_audit.audit(spark, a, a).collect())
    other = {r.page_id: r.status for r in warc_audit.audit(spark, b, a).collect() if r.status != "ok"}
    assert other == {7: "missing_in_a", 600: "missing_in_a", 123: "corrupt"}


def test_records_are_valid_and_told_apart(spark):
    """Mandatory fields, no record id twice even for pages that repeat, a body that looks like a record, extra columns and a very long page."""
    rows = [(1, "u", "x", "d"), (1, "u", "x", "d"), (2, "v", "WARC/1.1\r\nWARC-Type: resource\r\n\r\ny", "e"), (3, "w", "long é " * 60_000, "f"), (4, "x", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, segment string")
    path = scratch(spark, "test-warc")
    warc_audit.write_replica(pages, path, segments=2)
    got = warc_audit.read_replica(spark, path)
    assert sorted((r.page_id, r.body) for r in got.collect()) == sorted((i, h or "") for i, _, h, _ in rows)
    assert got.filter("not intact").isEmpty()
    whole = "\r\n".join(r.value for r in spark.read.option("lineSep", "\r\n").text(path).collect())
    ids = re.findall(r"WARC-Record-ID: <urn:uuid:([0-9a-f-]{36})>", whole)
    assert len(ids) == len(set(ids)) == 5 and whole.count("WARC-Date: 1970-01-01T00:00:00Z") == 5


def test_a_missing_record_changes_only_the_nodes_above_it(spark):
    records = spark.range(600).select(F.lit(0).cast("long").alias("segment"), F.col("id").alias("ordinal"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), (F.col("id") % 7 + 10).alias("length"))

    def leaves(rows):
        start = F.coalesce(F.sum("length").over(Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return rows.select("segment", F.col("ordinal").alias("node"), "digest", start.alias("start"), "length")

    one, two = warc_audit.tree(leaves(records)), warc_audit.tree(leaves(records.filter("ordinal <> 300")))
    both = one.select("level", "node", F.col("digest").alias("a")).join(two.select("level", "node", F.col("digest").alias("b")), ["level", "node"])
    assert sorted((r.level, r.node) for r in both.filter("a <> b").collect()) == [(1, 300 // 16), (2, 300 // 256), (3, 0)]
    moved = warc_audit.tree(leaves(records.withColumn("length", F.when(F.col("ordinal") == 5, F.col("length") + 1).otherwise(F.col("length")))))
    assert moved.filter("level = 3").first().digest != one.filter("level = 3").first().digest


def test_files_in_no_segment_folder_are_read(spark, tmp_path):
    path = scratch(spark, "test-warc")
    warc_audit.write_replica(spark.createDataFrame([(k, f"u{k}", f"page {k}") for k in range(9)], "page_id long, url string, html string"), path, segments=1)
    spark.read.option("lineSep", warc_audit.END).text(f"{path}/segment=0").coalesce(1).write.option("lineSep", warc_audit.END).text(f"{tmp_path}/flat")
    got = warc_audit.read_replica(spark, f"{tmp_path}/flat").collect()
    assert len(got) == 9 and len({r.segment for r in got}) == 1 and all(r.intact for r in got)


def record(ordinal, body, page=1, version="1.1"):
    """A record's bytes; without an ordinal as another tool writes it."""
    own = f"WARC-Page-ID: {page}\r\nWARC-Record-Ordinal: {ordinal}\r\n" if ordinal is not None else ""
    return f"WARC/{version}\r\nWARC-Type: resource\r\n{own}Content-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n".encode()


def replica(folder, **files):
    """A replica of files of records."""
    folder.mkdir()
    for name, records in files.items():
        (folder / f"{name}.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    return str(folder)


def statuses(spark, a, b):
    return sorted((r.status, r.ordinal, r.record_offset, r.record_length) for r in warc_audit.audit(spark, a, b).collect() if r.status != "ok")


def test_repeated_and_unreadable_records_are_reported(spark, tmp_path):
    good = [record(k, f"body {k}", k) for k in range(20)]
    foreign = record(None, "from elsewhere")
    a = replica(tmp_path / "a", one=good)
    b = replica(tmp_path / "b", one=[*good[:5], good[3], *good[5:], foreign])
    at = [sum(map(len, good[:5])), sum(map(len, good)) + len(good[3])]
    assert statuses(spark, a, b) == [("extra_in_b", 3, at[0], len(good[3])), ("unreadable_in_b", None, at[1], len(foreign))]
    assert [s[0] for s in statuses(spark, b, a)] == ["extra_in_a", "unreadable_in_a"]
    assert statuses(spark, b, b) == [] and warc_audit.audit(spark, b, b).count() == 22
    # a record whose ordinal is damaged is missing, and what stands there instead is told; offsets behind it stay real
    hurt = good[7].replace(b"Ordinal: 7", b"Ordinal: ?")
    c = replica(tmp_path / "c", one=[*good[:7], hurt, *good[8:9], record(9, "BODY 9", 9), *good[10:]])
    before = sum(map(len, good[:7]))
    assert statuses(spark, a, c) == [("corrupt", 9, before + len(good[7]) + len(good[8]), len(good[9])), ("missing_in_b", 7, before, len(good[7])), ("unreadable_in_b", None, before, len(hurt))]
    assert [s[1:3] for s in statuses(spark, c, a)] == [(9, before + len(hurt) + len(good[8])), (7, before), (None, before)]


@pytest.mark.parametrize("version", ["1.0", "1.1"])
def test_replicas_of_another_tool_go_by_position(spark, tmp_path, version):
    rows = [record(None, f"page {k}", version=version) for k in range(40)]
    a = replica(tmp_path / "a", one=rows[:25], two=rows[25:])
    b = replica(tmp_path / "b", one=[*rows[:3], record(None, "other", version=version), *rows[4:25]], two=rows[25:])
    assert [s[:2] for s in statuses(spark, a, b)] == [("corrupt", 3)]
    assert warc_audit.audit(spark, a, b).count() == 40
    single = [replica(tmp_path / n, one=[record(None, n)]) for n in ("x", "y")]
    assert [s[0] for s in statuses(spark, *single)] == ["corrupt"]


def test_added_line_ends_and_a_lost_end_are_damage(spark, tmp_path):
    good = [record(k, f"body {k}", k) for k in range(4)]
    a = replica(tmp_path / "a", one=good)
    assert [s[:2] for s in statuses(spark, a, replica(tmp_path / "b", one=[good[0], good[1] + b"\r\n\r\n", *good[2:]]))] == [("corrupt", 1)]
    cut = replica(tmp_path / "c", one=[*good[:3], good[3][:-9]])
    assert [s[:2] for s in statuses(spark, a, cut)] == [("corrupt", 3)]
    assert [r.ordinal for r in warc_audit.read_replica(spark, cut).filter("not intact").collect()] == [3]


def test_warc_of_awkward_pages(spark, messy, nothing):
    """The shared awkward rows as pages, with columns of clashing names."""
    pages = messy.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "start", "node", "bucket", F.lit("x").alias("segment"))
    a, b = scratch(spark, "test-warc"), scratch(spark, "test-warc")
    for path in (a, b):
        warc_audit.write_replica(pages, path, segments=3)
    got = warc_audit.audit(spark, a, b).collect()
    assert len(got) == messy.count() and {r.status for r in got} == {"ok"}


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    a = scratch(spark, "test-warc")
    warc_audit.write_replica(none, a)
    assert warc_audit.audit(spark, a, a).count() == 0


def test_warc_replicas_from_one_order_are_those_written_alone(spark):
    """The drill's replicas are dealt out and sorted once, and hold what two runs of write_replica hold, empty ones too."""
    pages = spark.createDataFrame([(k if k % 9 else None, f"u{k % 5}", f"page {k} " * (k % 40)) for k in range(400)], "page_id long, url string, html string").repartition(5)
    body, keep = F.when(F.col("page_id") == 123, "other").otherwise(F.col("html")), F.coalesce(~F.col("page_id").isin(7, 200), F.lit(True))
    a, b = scratch(spark, "test-warc"), scratch(spark, "test-warc")
    warc_audit.write_replica(pages, a, segments=3)
    warc_audit.write_replica(pages, b, segments=3, body=body, keep=keep)
    plans = warc_audit._records(pages, [("a", None, None), ("b", body, keep)], 3, None)._jdf.queryExecution().executedPlan().toString()
    assert plans.count("hashpartitioning(segment") == 1
    paths = warc_audit.write_replicas(pages, scratch(spark, "test-warc"), {"a": (None, None), "b": (body, keep)}, segments=3)
    for alone, path in ((a, paths["a"]), (b, paths["b"])):
        told = [sorted(map(str, warc_audit.read_replica(spark, p).drop("file").collect())) for p in (alone, path)]
        assert told[0] == told[1] and len(told[0]) > 390
    none = warc_audit.write_replicas(pages.limit(0), scratch(spark, "test-warc"), {"a": (None, None), "b": (body, keep)})
    assert warc_audit.audit(spark, none["a"], none["b"]).count() == 0
