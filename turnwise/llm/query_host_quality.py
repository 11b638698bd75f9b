"""op2: quality rules over ``documents``, a source being a host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import host_quality
from turnwise.llm.common import read

NAME = "op2_quality_rules"

ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), twice AS (SELECT doc_id, g FROM runs GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT r.doc_id, unnest([i, i + 1, i + 2]) AS p FROM runs r JOIN twice USING (doc_id, g)) GROUP BY 1),
m AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
       - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS k FROM f GROUP BY 1),
s AS (SELECT sum(n) AS n, least(greatest(sum(k) / sum(n), 1e-6), 1 - 1e-6) AS mean, avg(k / n) AS plain, avg((k / n) * (k / n)) AS square, avg(1 / n) AS inverse FROM h),
v AS (SELECT n, mean, square - 2 * mean * plain + mean * mean - mean * (1 - mean) * inverse AS spread FROM s),
prior AS (SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1.0), n) ELSE n END AS strength FROM v),
verdict AS (SELECT source, (k + mean * strength) / (h.n + strength) > 0.6 AS host_rejected FROM h, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_rejected AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_quality.judged(read(spark, sf_dir, "documents"), "op2")
    return found.select(found["id"].alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
