"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The split pattern cuts a text into pieces, and merges never cross a piece. So
the library's BPE model merges every distinct piece once in a worker, and a
text is the chain of its pieces. The model is built from a file of ranks: any
two neighbours whose join has a rank may merge, lowest rank first. Tokens spell their
bytes in a byte-to-character table; decoding reverses the table and joins the
bytes of all tokens before it reads them as UTF-8, because a character may be
split over tokens.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, spread, table

def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: printable Latin-1 characters stand for themselves, the others for code points from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table_ = {b: chr(b) for b in plain}
    others = (b for b in range(256) if b not in table_)
    return table_ | {b: chr(256 + n) for n, b in enumerate(others)}


SPELLING = str.maketrans({chr(b): c for b, c in byte_characters().items()})


def spelt(piece: bytes) -> str:
    """A character for each byte."""
    return piece.decode("latin-1").translate(SPELLING)


def ranked(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merges(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """All pairs of tokens whose join is a token, in the order of its rank."""
    return [(spelt(t[:i]), spelt(t[i:])) for t in sorted(ranks, key=ranks.__getitem__) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]


class ByteBPE:
    """Encoder and decoder of one file of ranks with byte-level pieces."""

    def __init__(self, path: str, pattern: str):
        from tokenizers.models import BPE

        ranks = ranked(path)
        model = BPE({spelt(t): i for t, i in ranks.items()}, merges(ranks))
        self.pattern = regex.compile(pattern)
        self.pieces = Remembered(lambda piece: tuple([t.id for t in model.tokenize(spelt(piece.encode("utf-8", "surrogatepass")))]))
        self.bytes_of = {i: t for t, i in ranks.items()}

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces
        return [i for p in self.pattern.findall(text) for i in pieces[p]]

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """The characters that each token touches; tokens of one split character have the same offsets."""
        found = []
        for m in self.pattern.finditer(text):
            # the character that each byte belongs to
            char = [n for n, c in enumerate(m[0], m.start()) for _ in c.encode("utf-8", "surrogatepass")]
            at = 0
            for i in self.pieces[m[0]]:
                end = at + len(self.bytes_of[i])
                found.append((char[at], char[end - 1] + 1))
                at = end
        return found

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _lists(rows: Iterable[list[int]]) -> pa.ListArray:
    """Rows of whole numbers as one Arrow array, without keeping them as Python objects."""
    flat, ends = array("i"), array("i", [0])
    for r in rows:
        flat.extend(r)
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


@cache
def loaded(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """doc_id and ids of every whole text, and if asked for each token's first and last+1 character."""
    ddl = "doc_id long, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            columns = [b.column(0), _lists(map(coder.encode, texts))]
            if offsets:
                spans = [coder.offsets(t) for t in texts]
                columns += [_lists([s[k] for s in x] for x in spans) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "starts", "ends"][: len(columns)])

    return _slim(docs, key, text).mapInArrow(run, ddl)


def decoded(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of (doc_id, ids) rows. Bytes that are no UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path, pattern)
        for b in batches:
            texts = [coder.decode_bytes(x or []).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per document: n_tokens, the SHA-256 of the decimal ids joined by one space, and that of the decoded bytes; if asked for also the ids.

    Null counts as the empty text, which has no tokens; a null id stays null;
    repeated rows give repeated results; an empty table gives an empty one;
    further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path, pattern)
        sha = hashlib.sha256
        for b in batches:
            counts, of_ids, of_bytes, flat = [], [], [], array("i")
            for ids in map(coder.encode, b.column(1).to_pylist()):
                counts.append(len(ids))
                if keep_ids:
                    flat.extend(ids)
                of_ids.append(sha(" ".join(map(str, ids)).encode()).hexdigest())
                of_bytes.append(sha(coder.decode_bytes(ids)).hexdigest())
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(counts)], pa.int32()), pa.array(flat, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return _slim(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else ""))


def _slim(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def public_coder() -> tuple[str, str]:
    """Path and pattern of the public 50k vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spread(table(spark, sf_dir, "documents")), *public_coder())
