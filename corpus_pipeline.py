"""A training corpus from raw documents: quality, repeated lines, near duplicates, leaks, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written down and read
again as the next stage's documents; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.llm import decontaminate, line_dedup, near_dedup, quality, sentencepiece_codec
from fieldlake.llm.common import WORD, table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts have the labels' share as their score."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents that have no word left.

    So a later copy of a whole document goes here, and doesn't end up as an empty row; null, empty
    and blank texts go too.  Every other document stays with what is its own.
    """
    return line_dedup.dedup_lines(docs).select(docs.columns).filter(F.col("text").rlike(WORD))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; texts without words are in none."""
    return near_dedup.keep_one(docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands go; without items all stay."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, one row for each document."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality", good_documents),
    ("line_dedup", first_lines),
    ("near_dedup", one_of_each),
    ("decontaminate", no_leaks),
    ("sentencepiece", tokens),
]

#: The classifier and the tokeniser have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
