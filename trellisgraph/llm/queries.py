"""The corpus operators applied to the driver's tables: one thin query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_extract, langid, lm, matroska, quality, simhash, url_filter, wfst
from .common import fold, table


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), ["page_id", "url"])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that leaks into a document."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document stored as a Matroska file and read back."""
    return matroska.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op5_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document."""
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs), ["doc_id"])
    return found.select("doc_id", (fold("doc_id", langid.FOLDS) == langid.HELD).alias("held_out"), "lang_pred", "score")


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    coded = wfst.encode(docs, ["doc_id", "text_sha256"])
    return coded.select("doc_id", "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


def op10_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted examples of every conversation hold, read back."""
    return chat.read_back(chat.expand(chat.with_probe(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": op1_main_text,
        "op2_decontaminate": op2_decontaminate,
        "op3_matroska": op3_matroska,
        "op4_rule_ensemble": op4_rule_ensemble,
        "op5_log_bilinear": op5_log_bilinear,
        "op6_byte_cnn": op6_byte_cnn,
        "op7_url_cascade": op7_url_cascade,
        "op8_simhash": op8_simhash,
        "op9_wfst": op9_wfst,
        "op10_prefix_targets": op10_prefix_targets,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.ORACLE_SQL,
        "op7_url_cascade": url_filter.ORACLE_SQL,
        "op10_prefix_targets": chat.ORACLE_SQL,
    }
