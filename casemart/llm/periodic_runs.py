"""Runs of words that repeat with a period, found by an online sparse dynamic program over diagonals.

The diagonal of lag q holds, for each word, how many words up to it equal the
word q places before. For each word, its earlier occurrences lengthen the
matches of their lags; a lag that the word doesn't match ends there, and if
its match was long enough the run is emitted at once.

Word by word, a text of one word would have a match for every pair of words.
So lags from s to 2s-1 (s a power of two) are followed in steps of s words:
the occurrences of the next s words as a whole, at most s of them in reach,
lengthen the lags. A run of lag q matches on 3q words at least, which hold two
whole steps, and its exact ends are found from there by halves. Windows of s
words get numbers from those of s/2 words, two by two, so equal numbers are
equal words. That makes n log n steps for any text of n words, and none is
left out. A text in which no five words occur twice can't hold a run and is
done after its first look.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, spread, table

#: A run has so many words and so many periods at least.
SHORTEST, TIMES = 6, 4
#: Cells of matches that are looked at together.
CELLS = 1 << 20


def _matches(names: np.ndarray, step: int, n: int) -> Iterator[tuple[int, list[int]]]:
    """For each step of `step` words that occurs before at lags from step to 2*step-1: its number and those lags."""
    lags = np.arange(step, 2 * step)
    rows = max(1, CELLS // step)
    for low in range(1, n // step, rows):
        starts = np.arange(low, min(low + rows, n // step)) * step
        before = starts[:, None] - lags
        at, which = np.nonzero((names[before] == names[starts][:, None]) & (before >= 0))
        if len(at):
            cuts = np.flatnonzero(np.diff(at)) + 1
            for first, found in zip(at[np.r_[0, cuts]].tolist(), np.split(lags[which], cuts)):
                yield low + first, found.tolist()


def find_runs(words: list[bytes], shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of all runs in a list of words, by start, then period.

    A run is a stretch of consecutive words with smallest period q and at
    least max(shortest, times * q) words that neither neighbour extends.
    `times` is 4 or more, `shortest` 6 or more.
    """
    if shortest < 6 or times < 4:
        raise ValueError("runs have four periods and six words at least")
    n = len(words)
    if n < shortest or len(set(zip(words, words[1:], words[2:], words[3:], words[4:]))) == n - 4:
        return []  # a run matches itself on five words at least
    numbers: dict[bytes, int] = {}
    levels = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)]
    periods: dict[tuple[int, int], int] = {}  # smallest one by first word and end

    def ended(lag: int, first: int, end: int) -> None:
        """The match of a lag on steps from `first` up to `end` is over."""
        if end - first < 2:
            return
        x, y = first * step, end * step
        for size, names in zip([1 << k for k in range(len(levels) - 2, -1, -1)], levels[-2::-1]):
            if x - size >= lag and names[x - size] == names[x - size - lag]:
                x -= size
            if y + size <= n and names[y] == names[y - lag]:
                y += size
        run = x - lag, y
        if y - x + lag >= max(shortest, times * lag) and lag < periods.get(run, n):
            periods[run] = lag

    step = 1
    while True:
        active: dict[int, int] = {}  # lags that the last step matched, with the step at which their match began
        at = 0
        for block, lags in _matches(levels[-1], step, n):
            if block != at + 1:
                for lag, first in active.items():
                    ended(lag, first, at + 1)
                active = {}
            now = {lag: active.pop(lag, block) for lag in lags}
            for lag, first in active.items():
                ended(lag, first, block)
            active, at = now, block
        for lag, first in active.items():
            ended(lag, first, at + 1)
        if 2 * step * times > n:
            break
        names = levels[-1]
        seen, doubled = np.unique(names[:-step] * (int(names.max()) + 1) + names[step:], return_inverse=True)
        if len(seen) == len(doubled):
            break  # no window of this length occurs twice, so no longer one does
        levels.append(doubled)
        step *= 2
    return sorted((start, end - start, q) for (start, end), q in periods.items())


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    dropped = bytearray(len(words))
    for start, length, period in runs:
        dropped[start + period : start + length] = b"\1" * (length - period)
    return [w for w, gone in zip(words, dropped) if not gone]


def scanned(docs: DataFrame, shortest: int = SHORTEST, times: int = TIMES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, its runs by start and period, and the text without repeated periods.

    Words are what stands between ASCII white space, numbered from 0; the
    collapsed text joins those left by one blank. Null counts as the empty
    text: no words, no runs, an empty text. A null id stays null; repeated
    rows give repeated results; where two runs overlap a word goes if either
    drops it; an empty table gives an empty one; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, found, left = [], [], []
            for body in b.column(1).to_pylist():
                words = body.split()  # bytes split at ASCII white space only
                runs = find_runs(words, shortest, times)
                counts.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                left.append(b" ".join(collapse(words, runs)))
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(found, RUNS), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def run_rows(docs: DataFrame, **options) -> DataFrame:
    """One row per run: doc_id, start, length, period."""
    return scanned(docs, **options).select("doc_id", F.inline("runs"))


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text of the query's table: a tenth of the texts, by the CRC-32 of the id, repeats a stretch of itself up to its end."""
    number = F.crc32(F.col("doc_id").cast("string"))
    seed = F.floor(number / 10)

    def loop(words: Column) -> Column:
        n = F.size(words).cast("long")
        start = seed % n
        period = F.lit(1) + F.floor((n - start) / (F.lit(3) + seed % 8))
        again = F.transform(words, lambda w, i: F.when(i >= start, F.get(words, (start + (i - start) % period).cast("int"))).otherwise(w))
        return F.when(n > 0, F.array_join(again, " ")).otherwise("")

    words = F.regexp_extract_all(F.col("text"), F.lit(SPACE.replace("[", "([^") + ")"), F.lit(1))
    return docs.select("doc_id", F.when(number % 10 == 0, let(words, loop)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = looped(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    # exact: length / period by cross products; the first of equal ones is the one by start and period
    best = F.aggregate("runs", none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = scanned(docs).select("doc_id", "runs", F.sha2("collapsed", 256).alias("collapsed_sha256"), best.alias("best"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), "collapsed_sha256",
    )
