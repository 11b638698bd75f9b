"""op10: toxicity of every document, learnt from the labels outside the held-out part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import toxicity
from turnwise.llm.common import read

NAME = "op10_toxicity"

#: A fitted model is no SQL; tests measure held-out accuracy.
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
