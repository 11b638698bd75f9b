"""op11: the Merkle proof of every row of ``documents``, checked after tampering with a fifth of them."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import merkle
from turnwise.llm.common import materialize, read

NAME = "op11_merkle_manifest"

#: Levels that the SQL spells out for each tree: 16**5 rows of a source, as many sources.
_LEVELS = 5


def _climb(name: str, leaves: str) -> list[str]:
    """CTEs that climb from (node, tree, pos, d), one row a leaf, to the root, with the siblings of each level."""
    parts = [f"{name}0 AS (SELECT node, tree, pos, d, count(*) OVER (PARTITION BY tree) AS n FROM {leaves})"]
    for k in range(_LEVELS):
        # Nodes of the level, then their parents; a tree with one node left stays as it is.
        parts.append(f"{name}_g{k} AS (SELECT tree, pos // 16 AS up, list(d ORDER BY pos) AS ds FROM (SELECT DISTINCT tree, pos, d FROM {name}{k}) GROUP BY ALL)")
        parts.append(f"{name}_m{k} AS (SELECT tree, count(*) AS many FROM (SELECT DISTINCT tree, pos FROM {name}{k}) GROUP BY 1)")
        parts.append(
            f"{name}{k + 1} AS (SELECT node, c.tree AS tree, CASE WHEN many > 1 THEN c.pos // 16 ELSE c.pos END AS pos, "
            f"CASE WHEN many > 1 THEN sha256(array_to_string(ds, '')) ELSE d END AS d, n FROM {name}{k} c JOIN {name}_g{k} g ON c.tree = g.tree AND c.pos // 16 = g.up JOIN {name}_m{k} m ON c.tree = m.tree)"
        )
        parts.append(
            f"{name}_s{k} AS (SELECT node, many > 1 AS real, array_to_string(ds[: c.pos % 16], '') AS l, array_to_string(ds[c.pos % 16 + 2 :], '') AS r "
            f"FROM {name}{k} c JOIN {name}_g{k} g ON c.tree = g.tree AND c.pos // 16 = g.up JOIN {name}_m{k} m ON c.tree = m.tree)"
        )
    return parts


def _path(name: str, node: str) -> tuple[str, str]:
    joins = " ".join(f"JOIN {name}_s{k} AS {name}p{k} ON {name}p{k}.node = {node}" for k in range(_LEVELS))
    steps = ", ".join(f"CASE WHEN {name}p{k}.real THEN [{name}p{k}.l, {name}p{k}.r] END" for k in range(_LEVELS))
    return joins, steps


def _oracle() -> str:
    enc = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    head = " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars"))
    # CRC-32 of the decimal digits: each byte is put in by XOR, then eight times shifted.
    crc = (
        "xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), "
        "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(4294967295 AS BIGINT)), 4294967295)"
    )
    joins, steps = _path("a", "f.node")
    top_joins, top_steps = _path("b", "f.tree")
    return ",\n".join([
        f"WITH f0 AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, sha256({head} || {enc('text')}) AS leaf, "
        f"CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {enc(lower)}) END AS other FROM documents)",
        "f AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS node, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM f0)",
        "al AS (SELECT node, tree, pos, leaf AS d FROM f)",
        *_climb("a", "al"),
        f"sub AS (SELECT DISTINCT tree, d FROM a{_LEVELS})",
        "bl AS (SELECT tree AS node, 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, d FROM sub)",
        *_climb("b", "bl"),
        f"whole AS (SELECT DISTINCT d AS root FROM b{_LEVELS})",
        f"p AS (SELECT f.doc_id AS doc_id, leaf, other, sub.d AS subroot, root, list_filter([{steps}, {top_steps}], lambda x: x IS NOT NULL) AS path "
        f"FROM f JOIN sub ON f.tree = sub.tree CROSS JOIN whole {joins} {top_joins})",
    ]) + """
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(flatten(path), '')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM (SELECT *, list_reduce(list_prepend([coalesce(other, leaf), ''], path), lambda own, s: [sha256(s[1] || own[1] || s[2]), ''])[1] AS folded FROM p)
"""


ORACLE = _oracle()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    leaves = merkle.hashed(docs, changed={"text": F.when(tampered, lowered).otherwise(F.col("text"))})
    found = merkle.manifest(leaves, "op11").proofs()
    found = materialize(found.select("id", "digest", "other", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), merkle.folded(F.col("other"), F.col("path")).alias("folded_root")), "op11_proofs")
    return found.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
