"""A quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled
texts. A text is cut into short chunks, all of it, and every chunk is
compressed with either dictionary; short chunks cannot learn much from
themselves, so the dictionary decides how small they become. The difference of
the two compressed sizes, divided by the text's bytes, is the raw score, and a
logistic curve fitted on labelled texts that built no dictionary turns it into
the probability of label 1. A text of a few bytes says little about itself:
its log-odds lean to those of the labels at large, the more the shorter it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, table

#: Labelled texts of each class that the fit reads at most, and the bytes of them that come to the driver in all; texts beyond those, or of more than a 64th of them, are left out of the fit.
FIT_ROWS, FIT_BYTES = 1_200, 64 << 20
DICTIONARY_BYTES = 112_640
CHUNK_BYTES = 256
LEVEL = 3
#: A text of this many bytes has its log-odds half from itself, half from the labels' shares.
PRIOR_BYTES = 32
#: The documents to hold out: those with this remainder of crc32(id as text) modulo FOLDS.
FOLDS, HELD_OUT = 3, 1


@dataclass(frozen=True)
class Model:
    """Dictionaries (empty: none), the logistic curve's slope and shift, and the log-odds of the labels' shares."""

    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    shift: float = 0.0
    prior: float = 0.0

    def scores(self, texts: list[bytes]) -> np.ndarray:
        own = trust(texts)
        odds = own * (self.slope * differences(texts, self.good, self.bad) + self.shift) + (1 - own) * self.prior
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def trust(texts: list[bytes]) -> np.ndarray:
    n = np.array([len(t) for t in texts], dtype=float)
    return n / (n + PRIOR_BYTES)


def chunks(text: bytes) -> list[bytes]:
    return [text[i : i + CHUNK_BYTES] for i in range(0, len(text), CHUNK_BYTES)]


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts' own bytes where there are too few to train one."""
    parts = [c for t in texts for c in chunks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:]


def compressor(content: bytes):
    if not content:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress


def differences(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """(size with the bad dictionary - size with the good one) / bytes of the text; 0 for an empty text."""
    by_good, by_bad = compressor(good), compressor(bad)
    return np.array([sum(len(by_bad(c)) - len(by_good(c)) for c in chunks(t)) / max(len(t), 1) for t in texts])


def curve(x: np.ndarray, own: np.ndarray, prior: float, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the weighted logistic fit of own * (slope * x + shift) + (1 - own) * prior, by Newton's method with a small ridge."""
    spread = float(np.std(x)) or 1.0
    z = np.stack([own * x / spread, own], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w + (1 - own) * prior, -30, 30)))
        gradient = z.T @ (weight * (y - p)) - 1e-3 * w
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1])


def in_fold(key) -> F.Column:
    return F.crc32(F.encode(key.cast("string"), "utf-8")) % FOLDS == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """The model from at most fit_rows labelled texts of either class, none of them held out.

    Rows are chosen by a hash of the id, so the same rows serve at any
    partitioning. With labels of one class only, or none, the score is that
    class's share, or one half.
    """
    usable = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~in_fold(F.col("id")))
    shares = {r.y: r.n for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        sure = {(): 0.0, (1,): 10.0, (0,): -10.0}[tuple(shares)]
        return Model(shift=sure, prior=sure)
    prior = float(np.log(shares[1] / shares[0]))
    order = F.xxhash64(F.lit("fit"), "id")
    chosen = usable.filter("y = 1").orderBy(order, "id").limit(fit_rows).unionByName(usable.filter("y = 0").orderBy(order, "id").limit(fit_rows)).groupBy("id").agg(F.min("y").alias("y"))
    texts = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # 2 * fit_rows at most; of rows that repeat an id the one with the smallest hash, at any partitioning
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    size = F.octet_length("text").cast("long")
    so_far = F.sum(size).over(Window.orderBy(order, "id"))  # over the chosen rows
    found = found.filter(size <= FIT_BYTES // 64).withColumn("so_far", so_far).filter(F.col("so_far") <= FIT_BYTES)
    rows = sorted((r.id, r.y, r.text.encode()) for r in found.collect())
    build, rest = rows[::2], rows[1::2]
    good, bad = (dictionary([t for _, y, t in build if y == want]) for want in (1, 0))
    if not good or not bad:
        return Model(shift=prior, prior=prior)
    held = [t for _, _, t in rest]
    x, y = differences(held, good, bad), np.array([y for _, y, _ in rest])
    counts = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.array([shares[c] / counts[c] for c in y]) * len(y) / sum(shares.values())
    return Model(good, bad, *curve(x, trust(held), prior, y, weight), prior)


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, score, predicted.

    Null and empty texts score the labels' share of 1.
    Repeated rows score alike, an empty table gives an empty result, further
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.scores([t.encode() for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype("int32"))], names=["doc_id", "score", "predicted"])

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double, predicted int")


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(spread(docs), model).select("doc_id", F.coalesce(in_fold(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
