"""A training corpus in five stages.

Each stage works on all that the one before kept; its output is written as
Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import near_dup, pieces, substrings, tiling, weak_labels
from tramline.llm._job import staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the weak-label classifier rejects."""
    return weak_labels.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-copies, of its smallest id; rows that repeat id and text are one document and stay together."""
    return near_dup.distinct_texts(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out words of passages that also start earlier; documents of which nothing is left go."""
    return substrings.without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids, their number, and whether they decode to the text."""
    return pieces.encode(docs, verify=True).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality classifier", quality), ("near dedup", near_duplicates), ("substring dedup", substring_dedup), ("decontamination", decontaminate), ("sentencepiece", encode)]

#: The classifier, the sketches and the tilings aren't SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"stage{i}")[0]
    return docs
