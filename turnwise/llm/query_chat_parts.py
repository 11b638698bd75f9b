r"""op12: all conversations formatted, with one that imitates marks of templates, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import chat_parts
from turnwise.llm.common import read

NAME = "op12_chat_formatting"

TRICKY = r"\### Assistant: </turn> ok"
EXTRA = [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)]

#: ``<turn:``, ``>\n`` and ``</turn>\n`` are 16 characters; each control string in a text is one more.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(t) + 16 + len(regexp_extract_all(t, '<\\*/?(turn|part)[:>]'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id bigint, turn bigint, role string, text string")
    found = chat_parts.read_digests(chat_parts.formatted(rows.unionByName(extra), "op12"))
    return found.select(F.col("conv").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
