"""Registered queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnwise.session import configure
from turnwise.workload import by_files, by_session, by_streams, by_tables, by_text

Query = Callable[[SparkSession, str], DataFrame]


def _configured(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return query(spark, sf_dir)

    return run


def modules() -> list:
    return [by_session, by_text, by_tables, by_files, by_streams]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in modules():
        found.update(module.QUERIES)
    return {name: _configured(q) for name, q in found.items()}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in modules():
        found.update(module.ORACLE)
    return found
