"""From raw documents to sampled token sequences: the stages of a training corpus, each on all that the one before kept.

All stages but the last keep whole rows, with whatever further columns they have.  Null texts count as empty, null ids
are kept apart from others but equal to each other, repeated rows go at exact dedup (one of each stays), long texts are
read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriloom.llm import decontamination, exact_dedup, near_dedup, quality, sentencepiece_sampling
from veriloom.llm.common import docs_of, stash, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold, ties at it included; the ranking is learned from this input's labelled rows."""
    return quality.keep_good(docs, quality.fitted(spark, docs, sf_dir))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id; a null id is the smallest, and of rows that share id and text any one."""
    return exact_dedup.keep_one(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the one with the smallest id; a null id is the smallest."""
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget; null items are none."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each document, with their ids and inclusion scores."""
    return sentencepiece_sampling.encode(docs_of(docs), k=2, with_ids=True, slice_bytes=1_500_000)


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontaminate),
    ("sentencepiece", tokenize),
]

#: SQL can express neither the ranking nor the sketches nor the sampling; tests/llm/test_pipeline.py holds a plain version to compare with.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
