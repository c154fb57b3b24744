"""Registry of this subpackage's queries and their SQL; the entry module adds it where the subpackage exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, html_text, importance, langid, lm, mixing, multi_index, packing, simhash, substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(_table(spark, sf_dir, "documents"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_fingerprint that SQL can express: order of documents, lengths and edited texts."""
    return op1_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def op2_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.select(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_report(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_report(_table(spark, sf_dir, "documents"))


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search_report(_table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.component_report(_table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_report(_table(spark, sf_dir, "pages"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_report(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprint": op1_fingerprint,
    "op2_importance": op2_importance,
    "op3_substrings": op3_substrings,
    "op4_mixing": op4_mixing,
    "op5_multi_index": op5_multi_index,
    "op6_simhash": op6_simhash,
    "op7_html_text": op7_html_text,
    "op8_lm": op8_lm,
    "op9_packing": op9_packing,
    "op10_langid": op10_langid,
    "edited_texts": edited_texts,
}

ORACLES: dict[str, str] = {"op3_substrings": substrings.REPORT_SQL, "op4_mixing": mixing.REPORT_SQL, "edited_texts": fingerprint.EDITED_SQL}
