"""op4: every text of ``documents`` as token records, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import token_records
from turnwise.llm.common import read

NAME = "op4_token_records"

#: A tokenizer is no SQL; tests compare with the library and read the files byte by byte.
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = token_records.write_records(read(spark, sf_dir, "documents"), "op4")
    return token_records.read_digests(index, folder)
