"""Transcripts to the published metrics feed of one machine."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise import __version__, fixed
from turnwise.operators import records as R, sessions as S
from turnwise.session import materialize
from turnwise.sources import snapshots, transcripts


@dataclass(frozen=True)
class Feed:
    sessions: DataFrame
    lifetime: DataFrame
    meta: DataFrame
    machine: str
    now: datetime


def bronze(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Main and delegated transcript lines; both are written when they are read, so line numbers stay put."""
    return transcripts.read_transcripts(spark, root), transcripts.read_subagent_transcripts(spark, root)


def session_tables(spark: SparkSession, root: str, publish_excerpt: bool = False, deny: DataFrame | None = None, **lengths: int | None) -> DataFrame:
    """Finished session rows of a transcript folder, delegated work rolled up (``lengths``: those of the lists in a row)."""
    main, delegated = bronze(spark, root)
    records = materialize(R.read_records(main), "records")
    sub_records = materialize(R.read_records(delegated), "delegated_records")
    files = transcripts.attach_agent_type(spark, delegated.select("path", "parent_sid").distinct(), root)
    subagents = materialize(S.subagent_totals(files, sub_records), "subagents")
    built = S.build_sessions(records, subagents, publish_excerpt=publish_excerpt, deny=deny, **lengths)
    return materialize(S.link_resumes(materialize(built, "unlinked")), "sessions")


def build_feed(
    sessions: DataFrame, machine: str, now: datetime, verdicts: DataFrame | None = None,
    window_days: int | None = None, excerpts: bool = False,
) -> Feed:
    """Windowed sessions, lifetime counters of all of them, and the feed's metadata."""
    stamped = sessions.withColumn("machine", F.lit(machine))
    if verdicts is not None:
        stamped = S.attach_verdicts(stamped, verdicts)
    now_col = F.lit(now).cast("timestamp")
    lifetime = S.lifetime_totals(stamped).withColumn("machine", F.lit(machine))
    judged = verdicts.agg(F.count("*")).scalar() if verdicts is not None else F.lit(0).cast("bigint")
    meta = S.review_cost(stamped).select(
        F.lit(machine).alias("machine"), F.lit(str(fixed.FEED_SCHEMA_MAJOR)).alias("schema_version"), F.lit(__version__).alias("reader_version"),
        F.lit(now.isoformat()).alias("generated_utc"), F.lit(window_days).cast("int").alias("window_days"), F.lit(excerpts).alias("excerpts_published"),
        judged.alias("judged"), "judge_tokens", stamped.agg(F.count("*")).scalar().alias("lifetime_sessions"),
    )
    return Feed(S.recent(stamped, now_col, window_days), lifetime, meta, machine, now)


def publish(feed: Feed, out: str, batch: str | None = None) -> snapshots.Snapshot:
    """The machine's three tables as one snapshot, if they changed or the heartbeat is due."""
    return snapshots.publish({"sessions": feed.sessions, "lifetime": feed.lifetime, "meta": feed.meta}, out, feed.machine, feed.now, batch)
