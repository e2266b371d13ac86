"""A corpus pipeline of four stages: quality rules, toxicity, n-gram Jaccard join, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and reads it again as
the next stage's documents. The first three keep whole rows of ``documents``; the last returns the packed pieces of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beaconlake.llm import ngram_join, packing, quality_rules, toxicity
from beaconlake.llm.queries import table, toxicity_model
from beaconlake.llm.scratch import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and aren't far from every language reference."""
    return quality_rules.keep_good(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic by a model that learned from the labelled documents."""
    return toxicity.keep_clean(docs, toxicity_model(spark, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more)."""
    return ngram_join.keep_first(docs, ngram_join.JoinParams(words=5, percent=80))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in optimal length buckets and token-budget batches."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("toxicity", clean), ("ngram_join", distinct), ("packing", packed)]
#: Toxicity is a trained network, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
