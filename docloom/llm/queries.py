"""The registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codes, fingerprint, language, mixing, near, pages, pieces, quality, repeats, topk, trie, vectors, warc
from .common import table, tune


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op1_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("kept_text", "text")


def op2_encode_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark, 500)  # all arrays of a batch are held at once, beside the vocabulary
    return pieces.encode(table(spark, sf_dir, "documents"))


def op4_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return pages.main_text(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark, 300)  # the words of a batch are held at once, beside the tables
    return language.identify(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_resolve_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark, 10_000)
    return warc.resolved_pages(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return topk.top_k(table(spark, sf_dir, "embeddings"), topk.every())


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_remove_repeats": op1_remove_repeats,
    "op2_encode_pieces": op2_encode_pieces,
    "op3_mix_sources": op3_mix_sources,
    "op4_near_documents": op4_near_documents,
    "op5_near_vectors": op5_near_vectors,
    "op6_main_text": op6_main_text,
    "op7_language_id": op7_language_id,
    "op8_fingerprints": op8_fingerprints,
    "op9_quality": op9_quality,
    "op10_resolve_revisits": op10_resolve_revisits,
    "op11_vector_codes": op11_vector_codes,
    "op12_top_rows": op12_top_rows,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {"op1_remove_repeats": repeats.ORACLE, "op3_mix_sources": mixing.ORACLE, "op5_near_vectors": vectors.ORACLE, "op10_resolve_revisits": warc.ORACLE, "op11_vector_codes": codes.ORACLE, "op12_top_rows": topk.ORACLE, "op13_prefix_trie": trie.ORACLE}
