"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

Stages take ``(spark, docs, sf_dir)``; all but the last return the columns of documents. A stage writes its result itself,
in small batches of texts, and returns what it reads back; the tables that its operator wrote on the way are then
gone. The classifier learns from all labelled documents outside the held-out fifth."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, jaccard_join, quality_classifier, secret_scan
from .common import Scratch, table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def written(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch, since = Scratch(spark, stage.__name__), len(Scratch.made)
        out = scratch.write(stage(spark, docs, sf_dir), "rows")
        Scratch.release(since)
        return out

    return run


@written
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_classifier.keep_good(spark, docs, table(spark, sf_dir, "labels"))


@written
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return jaccard_join.keep_one(spark, docs)


@written
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return decontaminate.drop_leaks(spark, docs, table(spark, sf_dir, "benchmark"))


@written
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; the documents stay."""
    return secret_scan.redact(docs)


@written
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids``: the ids of what is left, as little-endian unsigned 32-bit integers."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("byte-level BPE", tokens),
]

#: The classifier and the tokenizer have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, as written. A stage's rows go when those of the next are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        at = len(Scratch.made)
        docs = stage(spark, docs, sf_dir)
        if before is not None:
            before.drop()
        before = Scratch.made[at]
    return docs
