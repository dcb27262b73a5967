"""Fixity audit of WARC replicas by Merkle trees.

Records are hashed in the order of their offsets. A node of the level above is
the hash of its FAN children's byte ranges (from the node's start) and
digests, up to one root for each segment, so a record out of place changes the
root as a damaged one does.
Two replicas with equal roots are equal. Where roots differ, only the children
of differing nodes are compared, level by level, until the damaged records are
found. Every record of a file is a leaf: by its ordinal, which a record that
follows a lost one keeps; one that tells an ordinal again by that and how many
came before it; one without a legible ordinal by its turn among these. In a
file whose records have none at all, as other tools write them, the position
serves.

Segments are WARC files that Spark's text writer makes: a record ends in two
line ends, which is the writer's separator. All hashing and comparing is
DataFrame work on digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, scratch, stored, table

FAN = 16
#: Bytes of a segment's records, about.
SEGMENT_BYTES = 1 << 23
#: The date of capture where the pages have none.
DATE = "1970-01-01T00:00:00Z"
#: Levels above the records: FAN ** LEVELS records fit below one root, and fuller segments only have a wider root.
LEVELS = 3
END = "\r\n\r\n"
#: What every record begins with, in either version of the format, and what ours do.
BEGIN = "WARC/1."
MARK = BEGIN + "1\r\n"
#: Leaves that repeat an ordinal are this far from it, once for each time.
AGAIN = 1 << 40


def segment_of(page_id: Column, url: Column, body: Column, segments: int) -> Column:
    whole = F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), url, F.md5(F.encode(body, "utf-8")))
    return F.pmod(F.conv(F.substring(F.md5(F.encode(whole, "utf-8")), 1, 8), 16, 10).cast("long"), F.lit(segments))


def record_id(segment: Column, ordinal: Column) -> Column:
    """A UUID of a record's place, which no other record has, also of pages that repeat."""
    h = F.md5(F.encode(F.concat_ws("/", F.lit("warc"), segment.cast("string"), ordinal.cast("string")), "utf-8"))
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def record_text(page_id: Column, url: Column, segment: Column, ordinal: Column, body: Column, date: Column) -> Column:
    """One record without its closing line ends. A body that holds or begins like a record's beginning travels in base64."""
    unsafe = body.contains(END + BEGIN) | body.startswith(BEGIN)
    block = F.when(unsafe, F.base64(F.encode(body, "utf-8"))).otherwise(body)
    return F.concat(
        F.lit(MARK + "WARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"),
        record_id(segment, ordinal),
        F.lit(">\r\nWARC-Date: "),
        date,
        F.lit("\r\nWARC-Target-URI: "),
        F.regexp_replace(url, r"[\r\n]", " "),
        F.lit("\r\nWARC-Page-ID: "),
        F.coalesce(page_id.cast("string"), F.lit("null")),
        F.lit("\r\nWARC-Record-Ordinal: "),
        ordinal.cast("string"),
        F.when(unsafe, F.lit("\r\nContent-Transfer-Encoding: base64")).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
        block,
    )


def segments_of(pages: DataFrame) -> int:
    """As many segments as hold about SEGMENT_BYTES each."""
    total = pages.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0)))).first()[0]
    return max(1, -(-(total or 0) // SEGMENT_BYTES))


def write_replica(pages: DataFrame, path: str, body: Column | None = None, keep: Column | None = None, segments: int | None = None, date: Column | None = None) -> None:
    """Writes the pages as segments of gzip-compressed WARC records in ascending page order.

    `body` replaces the stored page and `keep` leaves records out, both without
    any effect on the order: so a damaged replica can be made. A null page or
    address counts as empty, a null id is written as null. Pages that repeat
    are records of their own, in any order, as nothing tells them apart; an
    empty table gives no segment; further columns are not read. `date` is the
    capture's time (ISO 8601), DATE where there is none.
    """
    _segment_files(_records(pages, [(None, body, keep)], segments, date), path, ["segment"])


def write_replicas(pages: DataFrame, path: str, replicas: dict[str, tuple[Column | None, Column | None]], segments: int | None = None, date: Column | None = None) -> dict[str, str]:
    """Writes a replica for each name, with its own `body` and `keep` as in write_replica, and returns their paths. The pages are dealt out and put in order once for all of them."""
    _segment_files(_records(pages, [(name, body, keep) for name, (body, keep) in replicas.items()], segments, date), path, ["replica", "segment"])
    paths = {name: f"{path}/replica={name}" for name in replicas}
    for own in paths.values():  # one without records is an empty folder
        folder = pages.sparkSession._jvm.org.apache.hadoop.fs.Path(own)
        folder.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration()).mkdirs(folder)
    return paths


def _records(pages: DataFrame, replicas: list[tuple[str | None, Column | None, Column | None]], segments: int | None, date: Column | None) -> DataFrame:
    """replica, segment, ordinal, value: the records of each replica."""
    url, html = F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit(""))
    segments = segments or segments_of(pages)
    in_segment = Window.partitionBy("segment").orderBy("page_id", "url", "html")
    when = F.coalesce(date, F.lit(DATE)) if date is not None else F.lit(DATE)
    rows = pages.select("page_id", url.alias("url"), html.alias("html"), when.alias("date"), segment_of(F.col("page_id"), url, html, segments).alias("segment"))
    rows = rows.withColumn("ordinal", F.row_number().over(in_segment) - 1)

    def record(name: str | None, body: Column | None, keep: Column | None) -> Column:
        text = record_text(F.col("page_id"), F.col("url"), F.col("segment"), F.col("ordinal"), F.col("html") if body is None else F.coalesce(body, F.lit("")), F.col("date"))
        return F.struct(F.lit(name).cast("string").alias("replica"), F.when(F.lit(True) if keep is None else keep, text).alias("value"))

    return rows.select("segment", "ordinal", F.inline(F.array(*[record(*r) for r in replicas]))).filter(F.col("value").isNotNull())


def _segment_files(records: DataFrame, path: str, folders: list[str]) -> None:
    written = records.sortWithinPartitions(*folders, "ordinal")
    written.select(*folders, "value").write.partitionBy(*folders).option("lineSep", END).option("compression", "gzip").text(path)


def read_replica(spark: SparkSession, path: str) -> DataFrame:
    """segment, file, position, offset, ordinal, page_id, length (bytes with the closing line ends), digest, intact (its length is the one it names), and body.

    Segments are the folders segment=N of write_replica; files in no such
    folder are a segment for each file name (a hash of it). Records are
    numbered as they stand in their file, and offsets are the real ones in it,
    whatever the records say. `ordinal` is null where it is not legible.
    """
    raw = spark.read.option("lineSep", END + BEGIN).text(path)
    raw = raw.select(
        F.col("segment").cast("long") if "segment" in raw.columns else F.xxhash64("_metadata.file_name").alias("segment"),
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("nth"), "value",
    )
    # the reader takes the beginning of all records but the first of a file, and the closing line ends of all but the last
    parts = raw.withColumn("record", F.when(F.col("value").startswith(BEGIN), F.col("value")).otherwise(F.concat(F.lit(BEGIN), "value")))
    parts = parts.withColumns({"cut": F.locate(END, "record"), "ends": F.col("record").endswith(END), "short": F.expr(f"substring(record, 1, length(record) - {len(END)})")})
    head = F.substring("record", 1, F.col("cut"))
    block = F.when(F.col("cut") > 0, F.expr(f"substring(record, cut + {len(END)})")).otherwise("")
    named = F.try_to_number(F.nullif(F.regexp_extract(head, r"Content-Length: (\d+)", 1), F.lit("")), F.lit("999999999999")).cast("long")
    # what is asked of the texts is asked here, so only marks are put in order; both readings of a record that ends in line ends
    marks = parts.select(
        "segment", "file", "part", "nth", "ends", F.octet_length("value").alias("octets"), named.alias("named"), F.octet_length(block).alias("block"),
        F.try_to_number(F.nullif(F.regexp_extract(head, r"WARC-Record-Ordinal: (\d+)", 1), F.lit("")), F.lit("999999999999")).cast("long").alias("ordinal"),
        F.regexp_extract(head, r"WARC-Page-ID: (-?\d+)", 1).try_cast("long").alias("page_id"),
        F.sha2("record", 256).alias("digest"), F.when(F.col("ends"), F.sha2("short", 256)).alias("short_digest"),
        head.contains("Content-Transfer-Encoding: base64").alias("coded"), block.alias("body"), F.when(F.col("ends"), F.expr(f"substring(record, cut + {len(END)}, greatest(0, length(record) - cut - {2 * len(END) - 1}))")).alias("short_body"),
    )
    order = Window.partitionBy("segment", "file").orderBy("part", "nth")
    placed = marks.withColumns({"position": F.row_number().over(order) - 1, "last": F.lead("nth").over(order).isNull()})
    length = F.col("octets") + F.when(F.col("position") > 0, len(BEGIN)).otherwise(0) + F.when(F.col("last"), 0).otherwise(len(END))
    placed = placed.withColumn("length", length.cast("long"))
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    short = F.col("last") & F.col("ends")
    body = F.when(short, F.col("short_body")).otherwise(F.col("body"))
    own = F.col("block") - F.when(short, len(END)).otherwise(0)
    return placed.select(
        "segment", "file", F.col("position").cast("long").alias("position"), "offset", "ordinal", "page_id", "length",
        F.when(short, F.col("short_digest")).otherwise(F.col("digest")).alias("digest"),
        F.coalesce((F.col("named") == own) & (~F.col("last") | F.col("ends")), F.lit(False)).alias("intact"),
        F.when(F.col("coded"), F.decode(F.unbase64(body), "utf-8")).otherwise(body).alias("body"),
    )


def leaves(records: DataFrame) -> DataFrame:
    """segment, node, digest, start, length, page_id: a leaf for every record that was read, none left out."""
    place = ["file", "position"]
    own = Window.partitionBy("segment")
    foreign = F.max("ordinal").over(own).isNull()
    numbered = records.withColumn("ordinal", F.when(foreign, F.row_number().over(own.orderBy(*place)) - 1).otherwise(F.col("ordinal")).cast("long"))
    nth = F.row_number().over(Window.partitionBy("segment", "ordinal").orderBy(*place)).cast("long")
    node = F.when(F.col("ordinal").isNull(), -nth).otherwise(F.col("ordinal") + (nth - 1) * AGAIN)
    return numbered.select("segment", node.alias("node"), "digest", F.col("offset").alias("start"), "length", "page_id")


def tree(records: DataFrame) -> DataFrame:
    """level, segment, node, digest, start, length: the leaves (segment, node, digest, start, length) at level 0 and the nodes above them, all from one pass over the records' digests.

    A node's digest covers the ranges of its children counted from its own
    start: a record that is missing changes the nodes above it, and not those
    that come after it.
    """

    def ranges(children: Column) -> Column:
        return F.array_join(F.transform(children, lambda x: F.concat_ws(":", (x.start - F.get(children, F.lit(0)).start).cast("string"), x.length.cast("string"), x.digest)), ";")

    level = stored(records.select(F.lit(0).alias("level"), "segment", "node", "digest", "start", "length"), "warc-level")
    whole = level
    for n in range(1, LEVELS + 1):
        above = F.floor(F.col("node") / FAN) if n < LEVELS else F.lit(0).cast("long")
        level = level.groupBy("segment", above.alias("above")).agg(
            F.sha2(let(F.sort_array(F.collect_list(F.struct("node", "start", "length", "digest"))), ranges), 256).alias("digest"),
            F.min("start").alias("start"),
            F.sum("length").alias("length"),
        )
        level = level.select(F.lit(n).alias("level"), "segment", F.col("above").alias("node"), "digest", "start", "length")
        whole = whole.unionByName(level)
    return whole


def mismatches(one: DataFrame, two: DataFrame) -> DataFrame:
    """segment, node, digest_a, digest_b of the leaves that differ or that one replica lacks, found by descending from differing roots."""

    def at(t: DataFrame, n: int, side: str) -> DataFrame:
        return t.filter(F.col("level") == n).select("segment", "node", F.col("digest").alias(f"digest_{side}"))

    differ = ~F.col("digest_a").eqNullSafe(F.col("digest_b"))
    found = at(one, LEVELS, "a").join(at(two, LEVELS, "b"), ["segment", "node"], "full").filter(differ)
    for n in range(LEVELS - 1, -1, -1):
        above = F.floor(F.col("node") / FAN) if n < LEVELS - 1 else F.lit(0).cast("long")
        open_ = found.select("segment", F.col("node").alias("above"))
        below = [at(t, n, side).withColumn("above", above).join(open_, ["segment", "above"], "left_semi").drop("above") for t, side in ((one, "a"), (two, "b"))]
        found = below[0].join(below[1], ["segment", "node"], "full").filter(differ)
    return found


def audit(spark: SparkSession, path_a: str, path_b: str) -> DataFrame:
    """One row per record of either replica: page_id, segment, ordinal, record_offset, record_length, sha256_a, sha256_b, status.

    status: ok; corrupt (the two differ); missing_in_a, missing_in_b; and of
    records that only one replica has and that are none of the others' at all
    extra_in_a, extra_in_b (an ordinal that was there before) and
    unreadable_in_a, unreadable_in_b (no legible ordinal, so the record that
    it was is missing as well). A repeated or unreadable record that both have
    alike is ok, as the replicas are equal. Offsets and lengths are those in
    replica a's uncompressed file, or in b's where a lacks the record. Two
    empty replicas give an empty result.
    """
    a, b = (stored(leaves(read_replica(spark, p).drop("body")), "warc-records") for p in (path_a, path_b))
    tree_a, tree_b = (stored(tree(r), "warc-tree") for r in (a, b))
    bad = mismatches(tree_a, tree_b).select("segment", "node", "digest_a", "digest_b", F.lit(True).alias("bad"))
    here = a.select("segment", "node", F.col("digest").alias("sha256_a"), "start", "length", "page_id")
    there = b.join(bad.filter("digest_a is null"), ["segment", "node"], "left_semi").select("segment", "node", F.lit(None).cast("string").alias("sha256_a"), "start", "length", "page_id")
    rows = here.unionByName(there).join(bad, ["segment", "node"], "left")
    # an id that a's damaged record no longer tells is b's
    told = b.join(bad, ["segment", "node"], "left_semi").select("segment", "node", F.col("page_id").alias("page_b"))
    rows = rows.join(told, ["segment", "node"], "left")
    lacks = F.when(F.col("digest_b").isNull(), "a").otherwise("b")
    kind = F.when(F.col("node") < 0, "unreadable_in_").when(F.col("node") >= AGAIN, "extra_in_")
    other = F.when(F.col("digest_b").isNull(), "missing_in_b").otherwise("missing_in_a")
    status = F.when(F.col("bad").isNull(), "ok").when(F.col("digest_a").isNotNull() & F.col("digest_b").isNotNull(), "corrupt").otherwise(F.coalesce(F.concat(kind, lacks), other))
    return rows.select(
        F.coalesce("page_id", "page_b").alias("page_id"),
        "segment",
        F.when(F.col("node") >= 0, F.col("node") % AGAIN).alias("ordinal"),
        F.col("start").alias("record_offset"),
        F.col("length").alias("record_length"),
        "sha256_a",
        F.when(F.col("bad").isNull(), F.col("sha256_a")).otherwise(F.col("digest_b")).alias("sha256_b"),
        status.alias("status"),
    )


def op6_warc_audit(spark, sf_dir: str) -> DataFrame:
    """A drill on all pages: a second replica loses pages whose id leaves 7 modulo 193 and damages those that leave 5 modulo 97; the audit has to find them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    damaged = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("~"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    paths = write_replicas(pages, scratch(spark, "warc"), {"a": (None, None), "b": (damaged, F.coalesce(F.col("page_id") % 193 != 7, F.lit(True)))})
    return audit(spark, paths["a"], paths["b"])


OP6_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
n AS (SELECT greatest(1, CAST(ceil(sum(strlen(html) + strlen(url)) / {SEGMENT_BYTES}.0) AS BIGINT)) AS segments FROM p),
s AS (SELECT p.*, ('0x' || substr(md5(page_id || '|' || url || '|' || md5(html)), 1, 8))::BIGINT % segments AS segment FROM p, n),
o AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY page_id, url, html) - 1 AS ordinal,
             CASE WHEN page_id % 97 = 5 THEN '~' || substr(html, 2) ELSE html END AS other FROM s),
h AS (SELECT *, md5('warc/' || segment || '/' || ordinal) AS h, chr(13) || chr(10) AS nl FROM o),
r AS (SELECT page_id, segment, ordinal,
             'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:uuid:' || concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) || '>'
             || nl || 'WARC-Date: {DATE}' || nl || 'WARC-Target-URI: ' || regexp_replace(url, '[\r\n]', ' ', 'g') || nl || 'WARC-Page-ID: ' || page_id || nl || 'WARC-Record-Ordinal: ' || ordinal
             || nl || 'Content-Type: text/html' || nl || 'Content-Length: ' AS head,
             strlen(html) || nl || nl || html AS tail, strlen(other) || nl || nl || other AS tail_b FROM h),
d AS (SELECT *, strlen(head || tail) + 4 AS len, sha256(head || tail) AS sha256_a,
             CASE WHEN page_id % 193 = 7 THEN NULL ELSE sha256(head || tail_b) END AS sha256_b FROM r)
SELECT page_id, segment, ordinal, CAST(sum(len) OVER (PARTITION BY segment ORDER BY ordinal) - len AS BIGINT) AS record_offset, CAST(len AS BIGINT) AS record_length,
       sha256_a, sha256_b, CASE WHEN sha256_b IS NULL THEN 'missing_in_b' WHEN sha256_a = sha256_b THEN 'ok' ELSE 'corrupt' END AS status
FROM d
"""
