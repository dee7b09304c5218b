"""The training-data pipeline: each stage takes what its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of
documents. `run` writes each result as Parquet in the folder of spark.checkpoint.dir and reads it
again, so a lost executor costs at most a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.common import materialize
from lodestar.llm.cotraining import drop_low_quality
from lodestar.llm.exact_dedup import drop_exact_copies
from lodestar.llm.minhash import drop_near_copies
from lodestar.llm.mixing import mixed_documents
from lodestar.llm.packing import pack
from lodestar.llm.tokens import public_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality and toxic ones go."""
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group linked at a similarity of 0.8 or more stays."""
    return drop_near_copies(docs, percent=80, members=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return pack(docs, public_path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: A trained classifier and a tokenizer are beyond SQL; tests hold the stages against brute force, each on what came before it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
