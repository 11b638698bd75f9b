"""op8: a verdict for every url of ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import url_filter
from turnwise.llm.common import read

NAME = "op8_url_filters"


def _oracle() -> str:
    fits = []
    for h, p, a in sorted(url_filter.RULES, key=lambda r: (len(r[0]) + len(r[1]), r), reverse=True):
        fits.append((f"(host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}')", h + p, a))
    case = lambda k: "CASE " + " ".join(f"WHEN {x[0]} THEN '{x[k]}'" for x in fits) + " END"
    parts = [
        rf"""
WITH u AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), m AS (SELECT *, {case(1)} AS rule, {case(2)} AS action FROM u),
l AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*([^"''\s>]+)', 1)) AS link FROM m),
t AS (SELECT src, CASE WHEN regexp_matches(link, '(?i)^https?://') THEN translate(regexp_extract(link, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    WHEN prefix(link, '//') THEN translate(regexp_extract('http:' || link, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN '' ELSE src END AS dst FROM l),
e AS (SELECT src, dst, count(*) AS links FROM t WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
moves AS (SELECT src, dst, links / sum(links) OVER (PARTITION BY src) AS part FROM e),
h AS (SELECT host, count(*) AS n, sum(CASE WHEN action = 'allow' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN action = 'block' THEN 1 ELSE 0 END) AS b FROM m WHERE host <> '' GROUP BY 1),
hosts AS (SELECT host, coalesce(a / n, 0) AS trust, coalesce(b / n, 0) AS distrust FROM h FULL JOIN (SELECT DISTINCT dst AS host FROM e) USING (host)),
r0 AS (SELECT host, trust AS t, 1.0::DOUBLE AS p, distrust AS d FROM hosts)"""
    ]
    go, stay = url_filter.DAMPING, 1 - url_filter.DAMPING
    for k in range(url_filter.ROUNDS):
        parts.append(
            f"r{k + 1} AS MATERIALIZED (SELECT host, {stay!r} * trust + {go} * coalesce(gt, 0) AS t, {stay!r} + {go} * coalesce(gp, 0) AS p, greatest(distrust, {go} * coalesce(gd, 0)) AS d FROM hosts "
            f"LEFT JOIN (SELECT dst AS host, sum(t * part) AS gt, sum(p * part) AS gp FROM r{k} JOIN moves ON host = src GROUP BY 1) USING (host) "
            f"LEFT JOIN (SELECT src AS host, sum(d * part) AS gd FROM r{k} JOIN moves ON host = dst GROUP BY 1) USING (host))"
        )
    parts.append(
        f"""v AS (SELECT host, t / p AS t, d FROM r{url_filter.ROUNDS})
SELECT page_id, m.host AS host, path, rule,
  coalesce(action, CASE WHEN round(d, 6) >= {url_filter.LEAST_DISTRUST} AND round(d, 6) > round(t, 6) THEN 'block' ELSE 'allow' END) AS verdict
FROM m LEFT JOIN v ON m.host = v.host
"""
    )
    return ",\n".join(parts)


ORACLE = _oracle()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judged(read(spark, sf_dir, "pages"), "op8")
    return found.select(found["id"].alias("page_id"), "host", "path", "rule", "verdict")
