"""op9: keeping probability and draw of every document for a raked mix of sources, languages and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import mixing
from turnwise.llm.common import read

NAME = "op9_mixing"


def _oracle() -> str:
    parts = [
        r"""
WITH r AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN (length(t) - length(replace(t, '|', ''))) * 50 > length(t) THEN 'table'
      WHEN (length(t) - length(regexp_replace(t, '[#*$%&<>]', '', 'g'))) * 20 > length(t) THEN 'symbols'
      WHEN length(t) < 500 THEN 'note' ELSE 'prose' END AS topic,
    CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)
), c0 AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS raked FROM r GROUP BY ALL)"""
    ]
    for d in mixing.DIMENSIONS:
        parts.append(
            f"t_{d} AS (SELECT {d}, pow(x, {mixing.TEMPER}) / sum(pow(x, {mixing.TEMPER})) OVER () * sum(x) OVER () AS goal "
            f"FROM (SELECT {d}, sum(tokens) AS x FROM c0 GROUP BY 1) WHERE x > 0)"
        )
    step = 0
    for _ in range(mixing.ROUNDS):
        for d in mixing.DIMENSIONS:
            parts.append(f"c{step + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, raked * coalesce(goal / held, 0) AS raked FROM (SELECT *, sum(raked) OVER (PARTITION BY {d}) AS held FROM c{step}) LEFT JOIN t_{d} USING ({d}))")
            step += 1
    parts.append(f"p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN raked / tokens / max(CASE WHEN tokens > 0 THEN raked / tokens END) OVER () ELSE 1 END AS p FROM c{step})")
    return ",\n".join(parts) + """
SELECT doc_id, r.source AS source, r.lang AS lang, r.topic AS topic, n_tokens, round(p, 6) AS probability,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix'), 1, 12) AS BIGINT) / 281474976710656.0 < p AS kept
FROM r JOIN p ON r.source = p.source AND r.lang = p.lang AND r.topic = p.topic
"""


ORACLE = _oracle()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, chances = mixing.probabilities(read(spark, sf_dir, "documents"), "op9")
    found = rows.join(chances, list(mixing.DIMENSIONS))
    return found.select(
        F.col("id").alias("doc_id"), *mixing.DIMENSIONS, "n_tokens", F.round("probability", 6).alias("probability"),
        (mixing.drawn(F.col("id")) < F.col("probability")).alias("kept"),
    )
