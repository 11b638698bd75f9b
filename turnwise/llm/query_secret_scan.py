"""op1: secrets in ``documents``, false positives removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import secret_scan
from turnwise.llm.common import read

NAME = "op1_secret_scans"

#: A fitted forest is no SQL; tests measure held-out accuracy.
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"), "op1", path_col="source")
    return found.select(F.col("id").alias("doc_id"), "start", "size", "digest", "format", "score", "secret")
