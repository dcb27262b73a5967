"""Exact deduplication over a cuckoo-filter index.

The index of one partition holds the live digests: a table of 16-bit
fingerprints, four to a bucket, each with the number of the stored digest it
stands for. A lookup that hits a fingerprint is verified against the digests
stored in the two candidate buckets, so a false positive never merges texts.
When an insertion moves fingerprints around too long, the table doubles and is
rebuilt from the stored digests.

Spark deals the digests out. Every task first indexes what it has read, so a
digest leaves a task once however many copies it has, then the partial entries
meet by digest and are merged by an index of the same kind.

StoredIndex keeps an index between runs: the rows by bucket, and of every
bucket a cuckoo filter of its live digests. A batch that comes in is probed
against the filters, only hits are looked up in the rows, and filters grow
from the stored digests when they overflow. Rows can be withdrawn: the next
smallest id speaks for a text then, and a digest without rows leaves its filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, discard, parallelism, spread, stored, table

SLOTS = 4
#: Moves of one insertion before the table doubles.
MAX_MOVES = 200
#: A task hands its partial entries on when it holds this many digests, which bounds its memory.
LIVE_LIMIT = 500_000

_MULT, _MASK = 0xD6E8FEB86659FD93, (1 << 64) - 1


class CuckooIndex:
    """Live digests (bytes) with the smallest id and the count of each."""

    def __init__(self, buckets: int = 1024):
        self.buckets = 1 << max(1, (buckets - 1).bit_length())
        self.keys: list[bytes | None] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.free: list[int] = []
        self._clear()

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def _clear(self) -> None:
        self.prints = [0] * (self.buckets * SLOTS)
        self.entries = [-1] * (self.buckets * SLOTS)

    def _place(self, digest: bytes) -> tuple[int, int]:
        whole = int.from_bytes(digest[:8], "little")
        return (whole >> 48) or 1, (whole & 0xFFFFFFFF) & (self.buckets - 1)

    def _other(self, bucket: int, fingerprint: int) -> int:
        return bucket ^ ((((fingerprint * _MULT) & _MASK) >> 20) & (self.buckets - 1))

    def find(self, digest: bytes) -> int:
        """The slot of a digest, or -1. A fingerprint alone never counts as a hit."""
        fingerprint, bucket = self._place(digest)
        for b in (bucket, self._other(bucket, fingerprint)):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.prints[slot] == fingerprint and self.keys[self.entries[slot]] == digest:
                    return slot
        return -1

    def add(self, digest: bytes, id_: int | None, count: int = 1) -> bool:
        """True if the digest is new."""
        slot = self.find(digest)
        if slot >= 0:
            entry = self.entries[slot]
            self.counts[entry] += count
            if self.ids[entry] is None or id_ is not None and id_ < self.ids[entry]:
                self.ids[entry] = id_
            return False
        if self.free:
            entry = self.free.pop()
            self.keys[entry], self.ids[entry], self.counts[entry] = digest, id_, count
        else:
            entry = len(self.keys)
            self.keys.append(digest)
            self.ids.append(id_)
            self.counts.append(count)
        if not self._put(digest, entry):
            self.grow()
        return True

    def remove(self, digest: bytes) -> bool:
        """Takes a live digest out. False if it isn't live."""
        slot = self.find(digest)
        if slot < 0:
            return False
        entry = self.entries[slot]
        self.prints[slot], self.entries[slot] = 0, -1
        self.keys[entry] = None
        self.free.append(entry)
        return True

    def _put(self, digest: bytes, entry: int) -> bool:
        fingerprint, bucket = self._place(digest)
        for b in (bucket, self._other(bucket, fingerprint)):
            for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.entries[slot] < 0:
                    self.prints[slot], self.entries[slot] = fingerprint, entry
                    return True
        for move in range(MAX_MOVES):
            slot = bucket * SLOTS + (fingerprint + move) % SLOTS
            self.prints[slot], fingerprint = fingerprint, self.prints[slot]
            self.entries[slot], entry = entry, self.entries[slot]
            bucket = self._other(bucket, fingerprint)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.entries[slot] < 0:
                    self.prints[slot], self.entries[slot] = fingerprint, entry
                    return True
        return False

    def grow(self) -> None:
        """Doubles the table, as often as it takes, from the stored digests."""
        while True:
            self.buckets *= 2
            self._clear()
            if all(self._put(k, n) for n, k in enumerate(self.keys) if k is not None):
                return

    def live(self) -> Iterator[tuple[bytes, int | None, int]]:
        return ((k, i, c) for k, i, c in zip(self.keys, self.ids, self.counts, strict=True) if k is not None)


ENTRY = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])


def _hand_on(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = list(index.live())
    for at in range(0, len(rows), 50_000):
        part = rows[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), ENTRY, strict=True)], schema=ENTRY)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task's rows, an entry for each digest; digests may come again after LIVE_LIMIT."""
    index = CuckooIndex()
    for b in batches:
        for digest, id_, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            index.add(digest, id_, n)
        if len(index) >= LIVE_LIMIT:
            yield from _hand_on(index)
            index = CuckooIndex()
    yield from _hand_on(index)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All entries of this partition's digests, which arrive sorted by digest: a digest is complete once a higher one comes."""
    index, last = CuckooIndex(), None
    for b in batches:
        for digest, id_, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if digest != last and len(index) >= LIVE_LIMIT:
                yield from _hand_on(index)
                index = CuckooIndex()
            last = digest
            index.add(digest, id_, n)
    yield from _hand_on(index)


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"))


def live_digests(keys: DataFrame) -> DataFrame:
    """digest, keep_id, n for every digest."""
    partial = keys.select("digest", "doc_id", F.lit(1).cast("long").alias("n")).mapInArrow(_partial, ENTRY_DDL)
    return partial.repartition(parallelism(keys.sparkSession), "digest").sortWithinPartitions("digest").mapInArrow(_merge, ENTRY_DDL)


ENTRY_DDL = "digest binary, keep_id long, n long"


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of white space became one
    space; null counts as empty, so null and empty texts are one group. The
    row with the smallest id stays. A null id is never the smallest unless all
    ids of its group are null; then keep_id is null and all its rows count as
    kept, as nothing tells them apart. Rows that repeat the smallest id all
    count as kept too. An empty table gives an empty result; further columns
    are not read.
    """
    keys = stored(keyed(docs, key, text), "digests")  # texts are read and hashed once
    live = live_digests(keys)
    # the side of the live digests has one row a digest, so Spark may split a digest with many rows
    return keys.join(live, "digest").select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


class CuckooFilter:
    """16-bit fingerprints of live digests, four to a bucket, without the digests: small enough to store and to send."""

    def __init__(self, buckets: int):
        self.index = CuckooIndex(buckets)

    @classmethod
    def of(cls, digests: list[bytes]) -> CuckooFilter:
        """Half full at first, and doubled as often as it takes."""
        made = cls(max(1, len(digests) // 2))
        while not all(map(made.add, digests)):
            made = cls(2 * made.index.buckets)
        return made

    def _slots(self, digest: bytes) -> tuple[int, list[int]]:
        fingerprint, bucket = self.index._place(digest)
        pair = {bucket, self.index._other(bucket, fingerprint)}
        return fingerprint, [slot for b in pair for slot in range(b * SLOTS, b * SLOTS + SLOTS) if self.index.prints[slot] == fingerprint]

    def __contains__(self, digest: bytes) -> bool:
        """False only for a digest that isn't live."""
        return bool(self._slots(digest)[1])

    def add(self, digest: bytes) -> bool:
        """False if there is no room: the filter has lost a digest then and must be made anew from all of them."""
        return self.index._put(digest, 0)

    def remove(self, digest: bytes) -> None:
        for slot in self._slots(digest)[1][:1]:
            self.index.prints[slot], self.index.entries[slot] = 0, -1

    def packed(self) -> bytes:
        return np.array(self.index.prints, "<u2").tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> CuckooFilter:
        prints = np.frombuffer(raw, "<u2").tolist()
        made = cls(len(prints) // SLOTS)
        made.index.prints, made.index.entries = prints, [0 if p else -1 for p in prints]
        return made


def _filter_of(stored_: pa.Table) -> CuckooFilter:
    """A bucket's filter, or an empty one."""
    return CuckooFilter.unpacked(stored_.column("filter")[0].as_py()) if stored_.num_rows else CuckooFilter(1)


def _probe(asked: pa.Table, filters: pa.Table) -> pa.Table:
    live = _filter_of(filters)
    return asked.append_column("hit", pa.array([d in live for d in asked.column("digest").to_pylist()], pa.bool_()))


def _filter_row(asked: pa.Table, made: CuckooFilter, full: bool) -> pa.Table:
    return pa.table({"bucket": asked.column("bucket").slice(0, 1), "filter": pa.array([made.packed()], pa.binary()), "full": [full]})


def _added(asked: pa.Table, filters: pa.Table) -> pa.Table:
    live = _filter_of(filters)
    full = not all(map(live.add, asked.column("digest").to_pylist()))
    return _filter_row(asked, live, full) if asked.num_rows else _filter_row(filters, live, False).slice(0, 0)


def _removed(asked: pa.Table, filters: pa.Table) -> pa.Table:
    live = _filter_of(filters)
    for digest in asked.column("digest").to_pylist():
        live.remove(digest)
    return _filter_row(asked, live, False) if asked.num_rows else _filter_row(filters, live, False).slice(0, 0)


def _rebuilt(digests: pa.Table) -> pa.Table:
    return _filter_row(digests, CuckooFilter.of(digests.column("digest").to_pylist()), False)


class StoredIndex:
    """Live rows and their digests in a shared folder, by bucket; both tables are only ever appended to.

    rows: bucket, digest, doc_id, n (rows that came, or went if negative).
    filters: bucket, version, filter; a bucket's last version counts. A filter
    is written before rows that come and after rows that went, so a run that
    is broken off leaves it too full at worst, which costs a lookup and loses
    nothing. Buckets are dealt by the digest, so they are alike in size; a
    text with very many rows is one digest in its bucket's filter.

    Null texts count as empty. Rows with a null id are not indexed, as nothing
    could withdraw them; rows that repeat id and text are counted, and each
    withdrawal takes one of them; withdrawing what isn't there does nothing.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        for name, ddl in (("rows", ROWS_DDL), ("filters", "bucket int, version int, filter binary")):
            spark.createDataFrame([], ddl).write.mode("append").parquet(f"{self.path}/{name}")

    def _read(self, name: str, ddl: str) -> DataFrame:
        return self.spark.read.schema(ddl).parquet(f"{self.path}/{name}")

    def _keyed(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        bucket = F.pmod(F.conv(F.substring(F.hex("digest"), 17, 8), 16, 10).cast("long"), F.lit(self.buckets)).cast("int")
        rows = keyed(docs, key, text).filter("doc_id is not null").withColumn("bucket", bucket)
        return stored(rows.groupBy("bucket", "digest", "doc_id").agg(F.count(F.lit(1)).alias("n")), "index-rows")

    def rows(self) -> DataFrame:
        """bucket, digest, doc_id, n of the live rows."""
        return self._read("rows", ROWS_DDL).groupBy("bucket", "digest", "doc_id").agg(F.sum("n").alias("n")).filter("n > 0")

    def filters(self) -> DataFrame:
        return self._read("filters", "bucket int, version int, filter binary").groupBy("bucket").agg(F.max_by("filter", "version").alias("filter"))

    def groups(self) -> DataFrame:
        """digest, keep_id (the smallest live id), n of every live text."""
        return self.rows().groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("n"))

    def _write_filters(self, rows: DataFrame) -> None:
        version = (self._read("filters", "bucket int, version int").agg(F.max("version")).first()[0] or 0) + 1
        rows.select("bucket", F.lit(version).alias("version"), "filter").write.mode("append").parquet(f"{self.path}/filters")

    def _changed(self, digests: DataFrame, change: Callable) -> DataFrame:
        return digests.groupBy("bucket").cogroup(self.filters().groupBy("bucket")).applyInArrow(change, "bucket int, filter binary, full boolean")

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Adds the rows; of each: doc_id, digest, known (the text was live before)."""
        rows = self._keyed(docs, key, text)
        asked = rows.select("bucket", "digest").distinct()
        probed = stored(asked.groupBy("bucket").cogroup(self.filters().groupBy("bucket")).applyInArrow(_probe, "bucket int, digest binary, hit boolean"), "index-probed")
        live = self.rows().join(probed.filter("hit").select("bucket", "digest"), ["bucket", "digest"], "left_semi").select("bucket", "digest").distinct()
        said = stored(probed.join(live.withColumn("known", F.lit(True)), ["bucket", "digest"], "left").select("bucket", "digest", F.coalesce("known", F.lit(False)).alias("known")), "index-known")
        fresh = said.filter("not known").select("bucket", "digest")
        made = stored(self._changed(fresh, _added), "index-filters")
        # filters that overflowed are made anew from the stored digests and those that came
        full = made.filter("full").select("bucket")
        anew = self.rows().select("bucket", "digest").unionByName(fresh).join(full, "bucket", "left_semi").distinct().groupBy("bucket").applyInArrow(_rebuilt, "bucket int, filter binary, full boolean")
        self._write_filters(made.filter("not full").unionByName(anew))
        rows.write.mode("append").parquet(f"{self.path}/rows")
        discard(probed, made)
        return rows.join(said, ["bucket", "digest"]).select("doc_id", "digest", "known")

    def withdraw(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Takes the rows out that have these ids and texts."""
        rows = self._keyed(docs, key, text)
        here = ["bucket", "digest", "doc_id"]
        live = self.rows()
        gone = stored(rows.join(live.withColumnRenamed("n", "live"), here).select(*here, (-F.least("n", "live")).alias("n")), "index-gone")
        touched = live.join(gone.select("bucket", "digest").distinct(), ["bucket", "digest"], "left_semi").select(*here, "n").unionByName(gone)
        dead = stored(touched.groupBy("bucket", "digest").agg(F.sum("n").alias("n")).filter("n = 0").select("bucket", "digest"), "index-dead")
        gone.write.mode("append").parquet(f"{self.path}/rows")
        self._write_filters(stored(self._changed(dead, _removed), "index-filters"))
        discard(rows, gone, dead)


ROWS_DDL = "bucket int, digest binary, doc_id long, n long"


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, all columns unchanged; of rows that repeat the id and the text, one stays."""
    groups = exact_groups(docs, key, text).filter("kept")
    keep = stored(groups.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("rows")), "kept-ids")
    id_name, hash_name = _free_name(docs, "keep_key"), _free_name(docs, "keep_hash")
    ids = keep.select(F.col("doc_id").alias(id_name), F.col("text_sha256").alias(hash_name))
    same = docs[key].cast("long").eqNullSafe(ids[id_name]) & (F.sha2(normalised(docs[text]), 256) == ids[hash_name])
    rows = docs.join(ids.hint("merge"), same, "left_semi")
    if keep.filter("rows > 1").isEmpty():
        return rows
    columns = rows.columns
    marked = rows.withColumn(hash_name, F.sha2(normalised(rows[text]), 256))
    return marked.dropDuplicates([key, hash_name]).select(*columns)


def _free_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spread(table(spark, sf_dir, "documents")))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
