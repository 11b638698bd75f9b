"""op3: components of ``documents`` whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import jaccard_join
from turnwise.llm.common import read

NAME = "op3_ngram_jaccard_join"

ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), rows_of AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS o
  FROM rows_of a JOIN rows_of b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (SELECT x, y FROM common WHERE 100 * o >= 90 * (nx + ny - o)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id
FROM sets s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = s.doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_classes(read(spark, sf_dir, "documents"), width=3, num=9, den=10, name="op3")
    return found.select(found["id"].alias("doc_id"), "n_shingles", "component_id")
