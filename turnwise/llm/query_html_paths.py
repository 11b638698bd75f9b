"""op5: main text of every row of ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import html_paths
from turnwise.llm.common import read

NAME = "op5_html_extraction"

#: Parsing is no SQL; tests compare with pages of known text.
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_paths.main_texts(read(spark, sf_dir, "pages"), "op5")
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
