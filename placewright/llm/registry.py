"""Queries of this subpackage and the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, html_text, kneser_ney, language_id, near_dedup, quality_rules, secret_scan, substring_dedup, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": kneser_ney.op1_quality_classifier,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_html_text": html_text.op8_html_text,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_url_filter": url_filter.op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op6_quality_rules": quality_rules.SQL,
    "op10_url_filter": url_filter.SQL,
}
