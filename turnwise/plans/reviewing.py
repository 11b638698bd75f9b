"""Sessions to a review queue, and returned verdicts to the store."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators import review
from turnwise.session import materialize
from turnwise.sources import sinks


def build_queue(
    sessions: DataFrame, records: DataFrame, prior: DataFrame, live: DataFrame, now: datetime,
    deny: DataFrame | None = None, limit: int | None = None, since: int | None = None, attempts: int | None = None, **digest: int | None,
) -> DataFrame:
    """Queue items of the sessions picked for review; only their records are digested (``digest``: limits of the digests)."""
    picked = materialize(review.review_queue(sessions, prior, live, F.lit(now).cast("timestamp"), limit, since, attempts), "picked")
    theirs = materialize(records.join(picked.select("path"), "path", "left_semi"), "picked_records")
    return review.queue_items(picked, review.build_digests(theirs, deny, **digest))


def ingest_batch(store: DataFrame, verdicts: DataFrame, queue: DataFrame, now: datetime, reject_path: str, batch: str | None = None) -> DataFrame:
    """Validate a batch, write the rejects with their reasons, and give the new store.

    A ``batch`` name makes the rejects of a run that is repeated replace those of the run before.
    """
    matched, stray = review.match_queue(verdicts, queue)
    checked = materialize(review.validate_verdicts(matched), "validated")
    rejects = checked.select("file_sid", "problems").unionByName(stray.select("file_sid", "problems"))
    sinks.write_rejects(rejects, reject_path, batch)
    return review.ingest(store, checked, F.lit(now).cast("timestamp"))
