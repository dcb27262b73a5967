"""Token ids as ORC files in ascending document order.

Spark's ORC writer run-length encodes the ids in stripes, keeps row indexes
for every `ROW_STRIDE` rows, and Bloom filters on the document ids. So readers
work stripe by stripe in parallel, and a filter on doc_id skips the stripes and
row groups whose metadata excludes it.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import spelt
from .common import Remembered, parallelism, scratch, stored, table

END_ID = 1
ROW_STRIDE = 10_000
STRIPE_BYTES = 64 << 20
ORC = {
    "compression": "zstd",
    "orc.stripe.size": str(STRIPE_BYTES),
    "orc.row.index.stride": str(ROW_STRIDE),
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
#: Chunks of printable Latin-1 only: composed already, lowered letter by letter, and without white space.
PLAIN = regex.compile(r"[!-~¡-¬®-ÿ]+")
STOPS = frozenset(".,;:!?")
#: The tokenizer's own split pattern.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


#: What the short cuts below rely on in a tokenizer file: Unicode composition, one blank for white space, lower case, this split, bytes as characters.
NORMALISED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = [{"type": "Split", "pattern": {"Regex": PIECE.pattern}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


class Encoder:
    """The library's ids of whole texts, as little-endian 32-bit bytes.

    A tokenizer that normalises and splits as above drops white space and
    merges nothing across it, so the ids of a text are those of its chunks
    between blanks, one after the other. A plain chunk is lowered and split
    here and merged piece by piece by the library's model; any other chunk
    goes through the whole tokenizer. So does every text that holds one of the
    tokenizer's special strings, and every text of any other tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        added = spec["added_tokens"]
        self.special = tuple(t["content"] for t in added)
        self.chunked = (
            spec["normalizer"] == NORMALISED and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": SPLIT} and spec["model"]["type"] == "BPE"
            and not (spec["post_processor"] or spec["truncation"] or spec["padding"]) and not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in added)
        )
        self.merge = self.tokenizer.model.tokenize
        self.pieces = Remembered(self.piece, 150_000)
        self.chunks = Remembered(self.chunk, 300_000)

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, piece: str) -> bytes:
        # printable ASCII stands for itself
        return packed([t.id for t in self.merge(piece if piece.isascii() else spelt(piece.encode()))])

    def chunk(self, chunk: str) -> bytes:
        word = chunk if chunk.isalpha() else chunk[:-1]
        if word.isascii() and word.isalpha() and (word is chunk or chunk[-1] in STOPS):
            # most new chunks: a word, perhaps with a stop, needs no pattern
            return self.pieces[word.lower()] if word is chunk else self.pieces[word.lower()] + self.pieces[chunk[-1]]
        if PLAIN.fullmatch(chunk):
            return b"".join([self.pieces[p] for p in PIECE.findall(chunk.lower())])
        return self.whole(chunk)

    def encode(self, text: str) -> bytes:
        if not self.chunked or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.chunks.__getitem__, cut(text)))


def cut(text: str) -> list[str]:
    """The chunks between blanks. A Latin-1 text is lowered first, as the tokenizer would letter by letter, so fewer chunks are new."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.replace("\n", " ").split(" ")
    return text.lower().replace("\n", " ").split(" ")


def packed(ids: list[int]) -> bytes:
    whole = array("I", ids)
    if sys.byteorder == "big":
        whole.byteswap()
    return whole.tobytes()


@cache
def loaded(path: str) -> Encoder:
    return Encoder(path)


def write_ids(docs: DataFrame, tokenizer_path: str, out: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Encodes every whole text, appends end_id, and writes doc_id, text_hash and ids in ascending order.

    The ids are those of Tokenizer.encode(text, add_special_tokens=False), so
    a special token's own string in a text becomes that token.

    Null texts count as empty and still get end_id; null ids come first; rows
    that repeat an id follow each other in the order of their texts' hashes;
    an empty table gives files without rows; further columns are not read.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(tokenizer_path)
        for b in batches:
            rows = [coder.encode(t) + end for t in b.column(2).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ids], names=["doc_id", "text_hash", "ids"])

    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    # dealt by range before encoding: what Spark samples for the bounds is then a plain scan
    dealt = slim.repartitionByRange(parallelism(docs.sparkSession), "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    dealt.mapInArrow(run, "doc_id long, text_hash long, ids array<int>").write.options(**ORC).orc(out)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, text_hash long, ids array<int>").orc(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens and the CRC-32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            ends = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], names=["file", "doc_id", "text_hash", "n_tokens", "ids_crc32"])

    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    rows = read_ids(spark, path).select(number.alias("file"), "doc_id", "text_hash", "ids")
    rows = stored(rows.mapInArrow(run, "file long, doc_id long, text_hash long, n_tokens long, ids_crc32 long"), "id-digests")
    so_far = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file, not for each document
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"))
    in_file = Window.partitionBy("file").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(in_file), F.lit(0)))
        .join(files, "file")
        .select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = scratch(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out)
    return file_digests(spark, out)
