"""Merging feeds of many machines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise import fixed
from turnwise.operators import sessions as S
from turnwise.schemas import COUNTERS


@dataclass(frozen=True)
class Merged:
    sessions: DataFrame
    machines: DataFrame
    skipped: DataFrame
    lifetime: DataFrame
    totals: DataFrame


def schema_gate(meta: DataFrame, major: int = fixed.FEED_SCHEMA_MAJOR) -> tuple[DataFrame, DataFrame]:
    """Feeds this reader understands, and the others by name."""
    fits = F.coalesce(F.floor(F.try_to_number(F.col("schema_version").cast("string"), F.lit("999.999"))) == major, F.lit(False))
    ok = meta.filter(fits)
    skipped = meta.filter(~fits).select("machine", "schema_version", "reader_version")
    return ok, skipped


def as_merged(df: DataFrame, machine: str) -> DataFrame:
    """Bring a single-machine table to the merged shape."""
    return df.withColumn("machine", F.lit(machine))


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Union tables of several machines; columns a machine lacks become null."""
    out = feeds[0]
    for feed in feeds[1:]:
        out = out.unionByName(feed, allowMissingColumns=True)
    return out


def merge_feeds(sessions: DataFrame, lifetime: DataFrame, meta: DataFrame, major: int = fixed.FEED_SCHEMA_MAJOR) -> Merged:
    """Merge understood feeds: counters summed, newest stamp kept."""
    ok, skipped = schema_gate(meta, major)
    names = ok.select("machine").distinct()
    per_machine = lifetime.join(names, "machine", "left_semi")
    totals = ok.agg(
        F.count("*").alias("machines"), F.coalesce(F.sum("judged"), F.lit(0)).alias("judged"),
        F.coalesce(F.sum("judge_tokens"), F.lit(0)).alias("judge_tokens"),
        F.coalesce(F.sum("lifetime_sessions"), F.lit(0)).alias("lifetime_sessions"), F.max("generated_utc").alias("generated_utc"),
    )
    return Merged(
        sessions.join(names, "machine", "left_semi"),
        ok.select("machine", "reader_version", "generated_utc", "excerpts_published", "window_days"),
        skipped,
        S.sum_counters(per_machine.select("model", *COUNTERS), ["model"]),
        totals,
    )


def newest_note(notes: DataFrame) -> DataFrame:
    """The newest coach note, with the machine it came from; first machine on equal dates."""
    rest = [c for c in notes.columns if c not in ("machine", "date")]
    newest = notes.agg(F.max("date")).scalar()
    return notes.filter(F.col("date") == newest).agg(F.min_by(F.struct("machine", "date", *rest), "machine").alias("n")).select("n.*")
