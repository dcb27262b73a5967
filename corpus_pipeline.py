"""The corpus pipeline: each stage works on all documents that the stage before it kept.

Quality rules reject documents; exact and near duplicates leave one document
of each group; mixing repeats documents of small sources until the weights are
met, each at most REPEAT_LIMIT times, and drops none; the last stage encodes
every document and keeps its ids.

Null texts count as empty and are rejected by the first stage. Rows that
repeat id and text leave as one; rows with a null id are kept like any other,
unless an equal text has an id. A null source is a source of its own. Empty
tables give empty ones at every stage, further columns pass through all but
the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casemart.llm import bpe, exact_dedup, mixing, near_dedup, quality
from casemart.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs, cover=True)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, *bpe.public_coder(), keep_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: Near duplicates are found by signatures and verified on the texts, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = stored(docs, f"stage-{n}")
    return docs
