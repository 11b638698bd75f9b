"""The registered query of every corpus operator, and its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import query_chat_parts, query_decontaminate, query_host_quality, query_html_paths, query_jaccard, query_merkle, query_mixing, query_secret_scan, query_subvector_kmeans, query_token_counts, query_token_records, query_toxicity, query_url_filter

MODULES = [
    query_secret_scan, query_host_quality, query_jaccard, query_token_records, query_html_paths, query_token_counts, query_decontaminate, query_url_filter,
    query_mixing, query_toxicity, query_merkle, query_chat_parts, query_subvector_kmeans,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE for m in MODULES if m.ORACLE}
