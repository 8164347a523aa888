"""From raw documents to token ids: the stages below, each over all that its predecessor kept.

Stages that filter or change take and return the columns of documents; the last returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import language, mixing, near, pieces, repeats
from docloom.llm.common import drop, table, tune, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; a null text, or one without letters, goes."""
    tune(spark)
    return language.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest doc_id; rows are judged
    by their own text, whatever doc_id they have."""
    tune(spark)
    return near.deduplicated(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the strings of 400 bytes and more that occur elsewhere, and without the passages of
    more than 50 words that another document has too; none goes."""
    tune(spark)
    return repeats.without_repeats(docs, words=51)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the mix takes, at most three; those it doesn't reach go."""
    tune(spark)
    return mixing.copies_taken(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document, with the four best segmentations."""
    tune(spark, 500)  # all arrays of a batch are held at once, beside the vocabulary
    return pieces.encode(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("source_mix", mix_sources),
    ("pieces", encode),
]

ORACLE_SQL = None  # language scores, sketches and lattices are beyond SQL; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next. What a
    stage has read is deleted once the next has been written; what the result reads stays."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir))
        drop(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
