"""The corpus pipeline: documents in, packed token ids out. Each stage is written and read again before the next.

Every stage takes null and empty texts, texts of any length, repeated rows, empty tables and further columns, which it passes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchline.llm import decontaminate, mixing, near_copies, resampling, simple8b
from pitchline.llm.common import table
from pitchline.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose n-grams tell them apart from good, harmless labelled ones go; 99 % of the labelled good ones stay.

    A null or empty text has no n-grams and weight 0. A document without an id stays; rows of one id go together.
    """
    return resampling.drop_rejected(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard similarity 0.8 or more) stays, the one with the smallest id.

    Texts without words are copies of one another. A document without an id stays; rows that repeat an id that stays, too.
    """
    return near_copies.drop_near_copies(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go. A null or empty text holds none; a document without an id stays."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens stay, shared out by the weights of domain, language and source.

    Documents are drawn by id, so one without an id has no place in any order and isn't drawn; a null language or source is a leaf of its own.
    """
    return mixing.keep_mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and from them doc_id, start, n_tokens and ids_crc32 of each document; a null text is empty."""
    return simple8b.encoded(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", clean_of_benchmark), ("mix", mix), ("tokens", tokens)]
#: The stages hash, sample and encode in ways that SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
