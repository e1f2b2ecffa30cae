"""From raw documents to token ids: quality, exact and near duplicates, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seasonspark.llm._shared import cut, table
from seasonspark.llm.bpe import bpe_encode
from seasonspark.llm.exact_dedup import exact_dedup
from seasonspark.llm.mixing import mixed_documents
from seasonspark.llm.near_dedup import near_dedup
from seasonspark.llm.quality import accepted


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingles of five words link at a similarity of 0.8 or more."""
    return near_dedup(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix to the target weights takes of each document, a row for each of its blocks and slots."""
    return mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document's whole text."""
    return bpe_encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("minhash near-dedup", near_stage),
    ("mixing sources", mixing_stage),
    ("bpe encoding", encoding_stage),
]

#: A classifier, a similarity join and an encoder are beyond SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
