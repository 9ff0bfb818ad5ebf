"""A corpus made ready for training: STAGES in order, each written as Parquet
and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir). All but the last return rows with
the columns of ``documents``; the last returns one row per document of the
token files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

A stage's rows are made when they are written, and whole rows go through
Python there: the stages that send them keep the session's Arrow batches small
(``spark.sql.execution.arrow.maxBytesPerBatch``, unless the session has it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farepath.llm import decontaminate, mixing, near_dup, quality
from farepath.llm.common import documents, keep_batches_small, written
from farepath.llm.queries import QUALITY_AT_LEAST, quality_model, token_index_of


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    keep_batches_small(spark)
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_quality(docs, model, QUALITY_AT_LEAST)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dup.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    keep_batches_small(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares, documents repeated as it takes."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary files, and where each document stands in them."""
    return token_index_of(spark, docs)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", encode_tokens),
]

#: Models, signatures and tokenizers are not SQL; the tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
