"""The training-data pipeline: quality, exact and near copies, secrets, packing.

Each stage is a function of (spark, docs, sf_dir) that works on every row the
stage before it kept; ``run`` writes each result as Parquet and reads it again
as the next one's input.  All stages but the last return the columns of
``documents``, whatever else these are called.

Null texts count as empty ones, and null and empty texts pass all stages that
the classifier lets them reach: they equal each other (the largest doc_id
stays), are near copies of nothing, hold no secret, and are one id to pack.
Rows with a null doc_id are no copy of anything.  Rows that repeat a doc_id and
its text are kept or dropped together; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trailbase.llm import near_dup, packing, radix_dedup, ranker, secrets
from trailbase.llm.queries import table, tokenizer
from trailbase.llm.workspace import Workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality ranker accepts."""
    return ranker.keep_quality(spark, docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    return radix_dedup.keep_one(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more), the document with the least doc_id."""
    return near_dup.keep_one(spark, docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mark."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, and where each lies in which sequence."""
    return packing.pack(spark, docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near-duplicate dedup", near), ("secret scan", redact), ("best-fit packing", pack)]

#: The stages before packing turn on a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = work.keep(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
