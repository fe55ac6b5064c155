"""A corpus pipeline: quality classifier, exact dedup, near dedup, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of documents. run()
writes every stage's rows as Parquet in the shared folder and reads them again as the next one's docs. Nulls and odd
input are as each operator's docstring says; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofgrid.llm import exact_dedup, mixing, near_dedup, packing, quality
from proofgrid.llm.common import stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labelled rows of documents, doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts that with the smallest id."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates that with the smallest id."""
    return near_dedup.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights: documents once, twice or in part."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", good), ("exact dedup", exact), ("near dedup", near), ("source mix", mixed), ("packing", packed)]

#: Hash orders, training and alignment aren't in SQL's reach; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
