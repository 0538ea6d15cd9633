"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import fresh_folder, read
from . import (byte_passages, collocations, decontaminate, hard_negatives, html_text,
               ngram_join, oracles, packing, secrets, toxicity, url_filter, warc, weighted_sketch, word_passages)


def tokenizer_path() -> str:
    """The vocabulary the packing query names, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(read(spark, sf_dir, "pages"), fresh_folder(spark, "warc"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(read(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", "n_chars")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read(spark, sf_dir, "documents"))


def op5_byte_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_passages.report(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sketch.fingerprints(read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_word_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_passages.report(read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), tokenizer_path())


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.report(read(spark, sf_dir, "pages"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.report(read(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.report(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_ngram_join, op3_html_text, op4_secrets, op5_byte_passages, op6_toxicity,
    op7_fingerprints, op8_decontamination, op9_word_passages, op10_packing,
    op11_url_filter, op12_hard_negatives, op13_collocations)}
ORACLES: dict[str, str] = {"op1_warc": oracles.WARC,
                           "op2_ngram_join": oracles.NGRAM_JOIN,
                           "op5_byte_passages": oracles.BYTE_PASSAGES,
                           "op8_decontamination": oracles.DECONTAMINATION,
                           "op9_word_passages": oracles.WORD_PASSAGES,
                           "op11_url_filter": url_filter.ORACLE_SQL,
                           "op12_hard_negatives": hard_negatives.ORACLE_SQL,
                           "op13_collocations": collocations.ORACLE_SQL}
