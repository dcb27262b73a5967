"""BPE encoding and decoding by dynamic programming over the prefixes of a piece.

BPE has a property that needs no merging at run time: two tokens may stand
side by side exactly if merging the bytes of both gives the two back, and a
chain of tokens is the encoding of its bytes exactly if all its neighbours may
stand side by side. So each prefix of a piece has one last token: the token
that ends there and may follow the last token of what stands before it. One
pass stores it for every prefix, and the ids are read off from the back.

The tokens that end at a place come from a suffix automaton of the whole
vocabulary: reading a byte keeps the longest suffix that occurs in any token,
and the suffix links below it pass all tokens that end there. A state holds
one token at most, because a token that ends another one occurs in places
where the longer one doesn't.

Work is linear in the piece, also where a piece is a whole text of one letter,
on which a queue of merges pays a logarithm.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import Remembered, spread, table
from .token_files import packed

#: The split pattern of the library's ByteLevel pre-tokenizer (a fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
NEVER = 1 << 60


class SuffixAutomaton:
    """Which of the given strings of bytes end at each place of a text.

    `go` has the moves by state * 256 + byte, `link` the state of the longest
    suffix that other places share, `depth` the longest string of a state, and
    `ends` the strings that end wherever the state does, longest first, with
    their lengths.
    """

    def __init__(self, strings: dict[bytes, int]):
        moves: list[dict[int, int]] = [{}]
        self.link, self.depth = array("i", [-1]), array("i", [0])
        own: dict[int, tuple[int, int]] = {}
        for string, number in strings.items():
            at = 0
            for byte in string:
                at = self._grow(moves, at, byte)
            own[at] = (number, len(string))
        # a state that was split after its string had ended there still ends it: its longest string is the given one
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(moves)
        for state in sorted(range(1, len(moves)), key=self.depth.__getitem__):
            below = self.ends[self.link[state]]
            self.ends[state] = (own[state], *below) if state in own else below
        self.go = {state << 8 | byte: to for state, out in enumerate(moves) for byte, to in out.items()}

    def _grow(self, moves: list[dict[int, int]], at: int, byte: int) -> int:
        """The state of the current string and one byte more."""
        link, depth = self.link, self.depth
        known = moves[at].get(byte)
        if known is not None:
            return known if depth[known] == depth[at] + 1 else self._split(moves, at, byte, known)
        new = len(moves)
        moves.append({})
        link.append(0)
        depth.append(depth[at] + 1)
        while at != -1 and byte not in moves[at]:
            moves[at][byte] = new
            at = link[at]
        if at != -1:
            to = moves[at][byte]
            link[new] = to if depth[to] == depth[at] + 1 else self._split(moves, at, byte, to)
        return new

    def _split(self, moves: list[dict[int, int]], at: int, byte: int, to: int) -> int:
        """The shorter strings of state `to`, up to that of `at` and the byte, get a state of their own."""
        link, depth = self.link, self.depth
        part = len(moves)
        moves.append(dict(moves[to]))
        link.append(link[to])
        depth.append(depth[at] + 1)
        link[to] = part
        while at != -1 and moves[at].get(byte) == to:
            moves[at][byte] = part
            at = link[at]
        return part


class PrefixBPE:
    """Encoder and decoder of one tokenizers file with byte-level pieces, whose merges make each token in one way."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec["pre_tokenizer"], spec["added_tokens"]
        as_bytes = {c: b for b, c in byte_characters().items()}
        if (
            model["type"] != "BPE" or spec["normalizer"] or spec["post_processor"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]
            or spec["decoder"]["type"] != "ByteLevel" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        ):
            raise ValueError(f"{path} is no byte-level BPE without further rules")
        vocab = model["vocab"]
        self.bytes_of = {i: bytes(map(as_bytes.__getitem__, t)) for t, i in vocab.items()}
        self.ids = {t: i for i, t in self.bytes_of.items()}
        #: Strings that are tokens wherever a text has them.
        self.added = {t["content"]: t["id"] for t in added}
        for t, i in self.added.items():
            self.bytes_of[i] = bytes(map(as_bytes.__getitem__, t)) if all(c in as_bytes for c in t) else t.encode()
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

        self.rank: dict[int, int] = {}  # of the merge of a left and a right token
        halves: dict[int, tuple[int, int]] = {}
        made: dict[int, int] = {}
        for n, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            if whole in halves or max(made.get(a, -1), made.get(b, -1)) >= n:
                raise ValueError(f"{path}: a token is made in two ways, or before its halves")
            self.rank[a << 32 | b], halves[whole], made[whole] = n, (a, b), n
        if any(len(t) > 1 and i not in halves for t, i in self.ids.items()) or len([t for t in self.ids if len(t) == 1]) < 256:
            raise ValueError(f"{path}: a token that no merge makes, or a byte without a token")
        # A token's edge: itself, its outer half, that one's outer half, and so on, each with the rank at which it goes into the one before.
        self.left_edge = {i: self._edge(i, halves, made, 0) for i in self.ids.values()}
        self.right_edge = {i: self._edge(i, halves, made, 1) for i in self.ids.values()}
        self.fitting: dict[int, bool] = {}  # by left token and right token
        self.automaton = SuffixAutomaton(self.ids)
        self.pieces = Remembered(lambda piece: packed(self.encode_piece(piece.encode())), 500_000)

    @staticmethod
    def _edge(token: int, halves: dict[int, tuple[int, int]], made: dict[int, int], side: int) -> list[tuple[int, int]]:
        edge, until = [(token, NEVER)], NEVER
        while token in halves:
            until, token = made[token], halves[token][side]
            edge.append((token, until))
        return edge

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b, side by side, stay as they are.

        Merging makes both from bytes on their own unless a merge across the
        border comes first. Such a merge is of two edge tokens that are there
        together: before the left one goes into its next, which comes first
        of equal merges, and not after the right one does.
        """
        known, rank, left = True, self.rank.get, self.left_edge[b]
        for x, till_x in self.right_edge[a]:
            x <<= 32
            for y, till_y in left:
                n = rank(x | y)
                if n is not None and n < till_x and n <= till_y:
                    known = False
                    break
        if len(self.fitting) >= 500_000:
            self.fitting.clear()
        self.fitting[a << 32 | b] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece of the split pattern."""
        go, link, depth, ends, fitting = self.automaton.go, self.automaton.link, self.automaton.depth, self.automaton.ends, self.fitting
        last, sizes = [-1], [0]  # of each prefix: its last token and that one's length
        state = length = 0
        for end, byte in enumerate(piece, 1):
            to = go.get(state << 8 | byte)
            while to is None:  # each byte is a token, so the empty string has a move
                state = link[state]
                length = depth[state]
                to = go.get(state << 8 | byte)
            state, length = to, length + 1
            for token, size in ends[state]:
                if size > length:
                    continue
                if size < end:
                    before = last[end - size]
                    fit = fitting.get(before << 32 | token)
                    if not (self.fits(before, token) if fit is None else fit):
                        continue
                last.append(token)
                sizes.append(size)
                break
        at, ids = len(piece), []
        while at:
            ids.append(last[at])
            at -= sizes[at]
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit numbers."""
        pieces = self.pieces
        if self.cut is None or not any(t in text for t in self.added):
            return b"".join([pieces[p] for p in PIECES.findall(text)])
        parts = self.cut.split(text)  # every second one is an added token
        return b"".join([packed([self.added[part]]) if n % 2 else b"".join([pieces[p] for p in PIECES.findall(part)]) for n, part in enumerate(parts)])

    def decode(self, ids: array) -> str:
        """The text of ids, added tokens included. Bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@cache
def loaded(path: str) -> PrefixBPE:
    return PrefixBPE(path)


def _numbers(ids: bytes) -> array:
    """Little-endian 32-bit numbers as an array."""
    numbers = array("I")
    numbers.frombytes(ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids of every whole text. Null counts as empty and has none; repeated rows give repeated results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        for b in batches:
            flat, ends = array("I"), array("i", [0])
            for t in b.column(1).to_pylist():
                flat.extend(_numbers(coder.encode(t)))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return _slim(docs, key, text).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text of (doc_id, ids) rows; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path)
        for b in batches:
            texts = [coder.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_tokens, the SHA-256 of its ids as little-endian 32-bit numbers, and that of the text decoded from them.

    The ids are those of Tokenizer.encode(text, add_special_tokens=False): an
    added token's own string in a text becomes that token. Null counts as the
    empty text, which has no tokens; a null id stays null; repeated rows give
    repeated results; an empty table gives an empty one; further columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sha = loaded(path), hashlib.sha256
        for b in batches:
            counts, of_ids, of_text = [], [], []
            for t in b.column(1).to_pylist():
                ids = coder.encode(t)
                counts.append(len(ids) // 4)
                of_ids.append(sha(ids).hexdigest())
                of_text.append(sha(coder.decode(_numbers(ids)).encode()).hexdigest())
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _slim(docs, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _slim(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def op13_prefix_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"))
