"""Merkle manifest of a table: one hash tree per source, one tree over the sources, and every row's proof.

Nodes carry labels instead of pointers.  Rows are ranked inside their tree, and a node covers the interval ``[lo, hi)`` of leaf ranks
below it.  On level ``l`` a node's bucket is ``lo div ARITY**l``, so

- an **ancestor** is found by an equi-join on (tree, bucket of the level) that containment of the intervals confirms;
- the **siblings** of a node are its parent's interval less its own: the children that end before it and those that begin after it.

Each level is written once, a ``1/ARITY`` part of the one below, every node with the (at most ``ARITY``) intervals and digests of its
children.  Proofs are attached from the top down: a node takes its parent's proof and puts its own siblings before it, so a proof is
made once for all leaves below and the leaves meet only the lowest level.  No join has more than one partner for a row, and no group is
larger than ``ARITY`` whatever the size of a source.

Ranks need no task to hold a source: rows are ranged by (source, id), and one row for every stretch of a source inside a partition
gives what comes before it.  Texts are hashed where they are read; from then on rows are digests.

Defined results: a null in a hashed column is ``-``; a null id comes first in its source and is not tampered with; a null source is a
tree of its own, the first; rows that repeat an id are leaves of their own, in the order of their digests; a source of one row is its own
subroot, and a table of one source has that subroot as root; an empty table has no rows; columns that are not named are not hashed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.common import materialize

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 16
_PATH = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """H: lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; a null as ``-``."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: dict[str, Column]) -> Column:
    return digest(*map(encoded, values.values()))


def tree_key(source: Column) -> Column:
    """A source as a key without nulls that sorts as sources do, null before all."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string")))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (with ``tree``) as a table with ``lo``, the rank in the tree by ``order``, ``hi`` = lo + 1, and ``n``, the tree's size."""
    order = ["tree", *order]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed, f"{name}_placed").withColumn("__part", F.shiftright("__at", 33))
    stretches = placed.groupBy("tree", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__held"))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    stretches = stretches.select(
        "tree", "__part", F.sum("__held").over(whole).alias("n"), (F.coalesce(F.sum("__held").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift")
    )
    found = placed.join(materialize(stretches, f"{name}_stretches"), ["tree", "__part"]).withColumn("lo", F.col("__at") + F.col("__shift"))
    return materialize(found.withColumn("hi", F.col("lo") + 1).drop("__at", "__part", "__shift"), f"{name}_leaves")


def levels(leaves: DataFrame, name: str, arity: int = ARITY) -> list[DataFrame]:
    """The nodes (tree, n, lo, hi, digest, children) of every level from 1 up to the tallest tree's root, after the leaves."""
    found, height, most = [leaves], 0, leaves.agg(F.max("n")).first()[0] or 0
    while arity**height < most:
        span = arity ** (height + 1)
        below = found[-1].where(F.col("n") > arity**height)  # trees that have more than one node on this level
        inner = below.groupBy("tree", "n", F.expr(f"lo div {span}L").alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
        nodes = inner.select(
            "tree", "n", F.element_at("children", 1)["lo"].alias("lo"), F.element_at("children", -1)["hi"].alias("hi"),
            digest(F.array_join("children.digest", "")).alias("digest"), "children",
        )
        found.append(materialize(nodes, f"{name}_level{height + 1}"))
        height += 1
    return found


def roots(tree_levels: list[DataFrame], arity: int = ARITY) -> DataFrame:
    """(tree, digest) of the node that is left of every tree."""
    found = None
    for height, nodes in enumerate(tree_levels):
        tops = _tops(nodes, height, arity).select("tree", "digest")
        found = tops if found is None else found.unionByName(tops)
    return found


def _tops(nodes: DataFrame, height: int, arity: int) -> DataFrame:
    """The roots among the nodes of a level."""
    return nodes.where((F.col("n") <= arity**height) & (F.lit(height == 0) | (F.col("lo") == 0)))


def attached(tree_levels: list[DataFrame], above: DataFrame, arity: int = ARITY) -> DataFrame:
    """The leaves with ``path``, the siblings to the left and right on each level upwards, then those of ``above``.

    ``above`` (tree, path, and what else is to be handed down) says how each tree's root goes on.
    """
    handed = [c for c in above.columns if c not in ("tree", "path")]
    held = None
    for height in reversed(range(len(tree_levels))):
        nodes = tree_levels[height]
        found = _tops(nodes, height, arity).join(above, "tree")
        if held is not None:
            span = arity ** (height + 1)
            parent = held.select(
                F.col("tree").alias("p_tree"), F.expr(f"lo div {span}L").alias("p_bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"),
                F.col("children").alias("p_children"), F.col("path").alias("p_path"), *handed,
            )
            inside = (F.col("tree") == F.col("p_tree")) & (F.expr(f"lo div {span}L") == F.col("p_bucket")) & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
            joined = nodes.where(F.col("n") > arity**height).join(parent, inside)
            before = F.filter("p_children", lambda c: c["hi"] <= F.col("lo"))
            after = F.filter("p_children", lambda c: c["lo"] >= F.col("hi"))
            own = F.struct(F.array_join(before["digest"], "").alias("left"), F.array_join(after["digest"], "").alias("right"))
            found = found.unionByName(joined.select(*nodes.columns, F.concat(F.array(own), "p_path").alias("path"), *handed))
        held = found
    return held


def proof(path: Column) -> Column:
    """H of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda own, s: digest(s["left"], own, s["right"]))


@dataclass(frozen=True)
class Manifest:
    """The node tables of the sources' trees and of the tree over them; level 0 are the leaves."""

    sources: list[DataFrame]
    top: list[DataFrame]
    arity: int

    def proofs(self) -> DataFrame:
        """The leaves with ``subroot``, ``root`` and ``path``."""
        empty = F.array().cast(_PATH)
        root = roots(self.top, self.arity).select("tree", empty.alias("path"), F.col("digest").alias("root"))
        over = attached(self.top, root, self.arity).select(F.col("source_tree").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
        return attached(self.sources, materialize(over, "merkle_over"), self.arity)


def manifest(leaves: DataFrame, name: str, arity: int = ARITY) -> Manifest:
    """Trees over ``leaves`` (tree, id, digest, and columns to keep)."""
    # Written before they are ranked: dealing rows out by range looks at them twice, and texts are to be hashed once.
    leaves = materialize(leaves.withColumn("__row", F.monotonically_increasing_id()), f"{name}_hashed")
    rows = ranked(leaves, ["id", "digest", "__row"], name).drop("__row")
    sources = levels(rows, name, arity)
    subroots = roots(sources, arity).select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "digest")
    return Manifest(sources, levels(ranked(subroots, ["source_tree"], f"{name}_top"), f"{name}_top", arity), arity)


def hashed(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", source_col: str = "source", changed: dict[str, Column] | None = None) -> DataFrame:
    """Leaves (tree, id, digest) of ``docs``; with ``changed`` (columns' other values) also ``other``, the leaf that they give."""
    values = {c: F.col(f"`{c}`") for c in columns}
    keep = [tree_key(F.col(f"`{source_col}`")).alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf_of(values).alias("digest")]
    if changed is not None:
        keep.append(leaf_of(values | changed).alias("other"))
    return docs.select(*keep)
