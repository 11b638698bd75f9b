"""Session tables kept up to date: folded rows replace the sessions they name, and what a fold cannot answer is computed anew.

A fold reports a session for a recompute when it changed after its state was dropped, or when lines were passed over.  Such sessions, and
only they, are read again from their files and assembled as in batch.  Either way a session's row replaces the one before it, in the bucket of its
path; a snapshot names the buckets that count, so readers see a micro-batch whole, and one that is replayed changes nothing.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators.records import read_records
from turnwise.operators.sessions import build_sessions
from turnwise.session import materialize
from turnwise.sources import snapshots
from turnwise.streaming import tail, whole_fold

TABLE = "sessions"


def recomputed(flagged: DataFrame, root: str) -> DataFrame:
    """Session rows, from all lines of their files, of the sessions (path, generation) given."""
    records = materialize(read_records(tail.read_paths(flagged, root)), "recomputed_records")
    return build_sessions(records).join(flagged.groupBy("path").agg(F.max("generation").alias("generation")), "path")


class Upkeep:
    """``foreachBatch`` body over :func:`whole_fold.stream_sessions`.

    ``root`` is the folder that the source follows, ``out`` the snapshots' folder, ``owner`` whose they are, ``name`` the query's (with the
    batch number it names what was published).
    """

    def __init__(self, root: str, out: str, owner: str, name: str = "upkeep", buckets: int = 64):
        self.root, self.out, self.owner, self.name, self.buckets = root, out, owner, name, buckets

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = snapshots.current(spark, self.out, self.owner)
        done = before.batch
        if done is not None and done.rpartition("/")[0] == self.name and int(done.rpartition("/")[2]) >= batch_id:
            return
        folded = materialize(batch, "folded")
        rows = whole_fold.session_rows(folded).filter(~F.col("needs_recompute")).drop("needs_recompute")
        flagged = folded.filter("needs_recompute").select("path", "generation")
        if not flagged.isEmpty():
            rows = rows.unionByName(recomputed(flagged, self.root), allowMissingColumns=True)
        rows = rows.drop("subagents").repartition(F.col("path"))
        parts = snapshots.upsert(rows, self.out, before, TABLE, ["path"], self.buckets)
        snapshots.commit(spark, self.out, before, {TABLE: parts}, {TABLE: rows.schema.json()}, f"{self.name}/{batch_id}", now=datetime.now(timezone.utc))


def sessions(spark, out: str, owner: str) -> DataFrame | None:
    """The sessions as of the newest snapshot; None before the first."""
    return snapshots.read(spark, snapshots.current(spark, out, owner), TABLE)
