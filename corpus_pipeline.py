"""The corpus pipeline: quality rules, toxicity, near-duplicates, mixing, packing.

Each stage works on all rows of its predecessor's result, which is written as Parquet into the shared folder and read
again. SQL cannot express the toxicity stage (a trained network), so there is no oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eqspark.llm import mixing, packing, quality_rules, simhash, toxicity
from eqspark.llm.common import materialize, table
from eqspark.llm.queries import tokenizer_path
from eqspark.session import ship

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from ``labels``, does not reject."""
    ship(spark)
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class."""
    ship(spark)
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that meets the source, language and topic targets."""
    return mixing.keep_mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    ship(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("toxicity", detoxify), ("simhash_dedup", near_dedup), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
