"""From raw documents to token-id files, stage by stage.

quality rules -> one document of each near-duplicate group -> no benchmark passages -> sources mixed to target
weights -> packed token ids. Every stage but the last returns documents with the columns they came with, whatever
further columns these are. A null or empty text fails the quality rules; later stages, given one, keep it: it has no
near-duplicates, no passages, and its end id alone. A null id is an id like any other. Repeated rows stay or go
together in quality rules and decontamination, and one stays after near duplicates. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waveloom.llm import decontaminate, jaccard, mixing, packing, quality
from waveloom.llm.encoding import default_tokenizer
from waveloom.llm.shared import new_path, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the boosted trees keep."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the least id."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep="clean")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have equal weight, as many as before in the mean."""
    return mixing.mix_sources(docs).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of all documents in packed files, and from these files one row per document."""
    return packing.read_ids(packing.write_ids(docs, new_path(spark, "token-ids"), default_tokenizer()))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_ids", token_ids),
]

#: SQL cannot state the boosted trees or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
