"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basalt.llm import bpe, decontaminate, language_id, line_dedup, near_dedup, quality, quotation, suffix_dedup, token_store, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.query,
    "op2_near_dedup": near_dedup.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_token_store": token_store.query,
    "op5_line_dedup": line_dedup.query,
    "op6_byte_bpe": bpe.query,
    "op7_quotation": quotation.query,
    "op8_decontaminate": decontaminate.query,
    "op9_warc": warc.query,
    "op10_quality": quality.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_near_dedup": near_dedup.SQL,
    "op3_suffix_dedup": suffix_dedup.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op7_quotation": quotation.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op9_warc": warc.SQL,
}
