"""Registration of the training-data queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docaudit.llm import bpe, chat, decontam, html, quality, rules, simhash, substring, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality_classifier": quality.op1_quality_classifier,
        "op2_html_extraction": html.op2_html_extraction,
        "op3_simhash": simhash.op3_simhash,
        "op4_bpe": bpe.op4_bpe,
        "op5_quality_rules": rules.op5_quality_rules,
        "op6_chat_format": chat.op6_chat_format,
        "op7_substring_dedup": substring.op7_substring_dedup,
        "op8_decontamination": decontam.op8_decontamination,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_url_filter": urls.op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_quality_rules": rules.SQL,
        "op6_chat_format": chat.SQL,
        "op7_substring_dedup": substring.SQL,
        "op8_decontamination": decontam.SQL,
        "op10_url_filter": urls.SQL,
    }
