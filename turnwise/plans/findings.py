"""Published feeds of all machines to ranked findings."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import redact
from turnwise.operators import merge, rules
from turnwise.session import materialize
from turnwise.sources import snapshots


def merged_feeds(spark: SparkSession, root: str) -> merge.Merged:
    """The feeds of all machines, each as of its newest snapshot; one with a file that is gone or does not open is left out whole."""
    there = snapshots.owners(spark, root)
    whole = [s for s in there if snapshots.intact(spark, s)]
    merged = merge.merge_feeds(*(snapshots.read(spark, whole, t) for t in ("sessions", "lifetime", "meta")))
    damaged = [(s.owner, None, None) for s in there if s not in whole]
    return replace(merged, skipped=merged.skipped.unionByName(spark.createDataFrame(damaged, merged.skipped.schema)))


def redact_feed(sessions: DataFrame) -> DataFrame:
    """Redact the columns that can hold free text, and only those."""
    out = redact.redact_columns(sessions, ["fp_excerpt"]) if "fp_excerpt" in sessions.columns else sessions
    if "j" in out.columns and "summary" in out.schema["j"].dataType.fieldNames():
        out = out.withColumn("j", F.col("j").withField("summary", redact.redact(F.col("j.summary"))))
    return out


def findings(
    sessions: DataFrame, now: datetime, days: int | None = 30, machines: tuple[str, ...] = (), resumed: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(ranked findings, locked rules, prepared sessions)`` for the sessions in view."""
    prepared = rules.prepare(redact_feed(sessions))
    seen = materialize(rules.visible_sessions(prepared, F.lit(now).cast("timestamp"), days, machines, resumed), "visible")
    evaluated = materialize(rules.evaluate(seen), "evaluated")
    return rules.rank_findings(evaluated), rules.locked_rules(evaluated), seen
