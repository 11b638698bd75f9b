"""op6: unigram token counts of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import token_counts
from turnwise.llm.common import read

NAME = "op6_token_counts"

#: Tests compare with the tokenizers library on the same vocabulary.
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
