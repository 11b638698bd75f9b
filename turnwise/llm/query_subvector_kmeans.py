"""op13: every vector of ``embeddings`` with its cluster after five rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import subvector_kmeans as K
from turnwise.llm.common import read

NAME = "op13_centroid_clustering"


def _oracle() -> str:
    parts = [
        f"WITH v AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS row, list_transform(embedding, lambda x: CAST(floor({K.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        f"WHERE len(embedding) = {K.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {K.DIMENSIONS})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{K.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v AS m FROM v QUALIFY c < {K.CENTROIDS})",
    ]
    for step in range(K.ROUNDS + 1):
        parts.append(
            f"a{step} AS MATERIALIZED (SELECT vec_id, row, v, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM (SELECT vec_id, row, v, c, "
            f"list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{step}) GROUP BY ALL)"
        )
        if step < K.ROUNDS:
            parts.append(
                f"c{step + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, c{step}.m) AS m FROM c{step} LEFT JOIN (SELECT c, list(x ORDER BY i) AS m FROM ("
                f"SELECT c, i, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{step}) GROUP BY c, i"
                f") GROUP BY c) n USING (c))"
            )
    last = K.ROUNDS
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} k ON a.c = k.c
"""


ORACLE = _oracle()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.cluster(K.integers(read(spark, sf_dir, "embeddings")), "op13")
    return found.rows.join(K.inertia(found), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
