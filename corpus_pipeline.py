"""The corpus pipeline: five stages from raw documents to token records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import stages
from turnwise.llm.common import materialize, prepare

#: (name, function) in order.  A function takes (spark, docs, sf_dir); its rows are the next one's docs.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.without_toxic),
    ("ngram_jaccard_join", stages.without_near_copies),
    ("benchmark_decontamination", stages.without_benchmark),
    ("mixing", stages.mixed),
    ("token_binary", stages.as_token_records),
]

#: A fitted model and a tokenizer are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
