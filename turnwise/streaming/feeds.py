"""Streaming upkeep with built-in operators."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators.ordered import count_if
from turnwise.operators.records import read_records
from turnwise.operators.sessions import build_sessions
from turnwise.session import materialize
from turnwise.sources.sinks import publish_if_changed

CHUNK = "path STRING, base_line_no BIGINT, lines ARRAY<STRING>"


def stream_chunks(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Follow a folder of immutable chunk files; offsets live in the checkpoint.

    A shipper writes appended lines as ``(path, base_line_no, lines)``.
    ``max_files`` bounds the work of one run where it is given; the rest waits for the next.
    """
    reader = spark.readStream.schema(CHUNK)
    chunks = (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).json(folder)
    return chunks.select("path", "base_line_no", F.posexplode("lines").alias("i", "value")).select(
        "path", (F.col("base_line_no") + F.col("i")).alias("line_no"), "value"
    )


def stream_records(lines: DataFrame) -> DataFrame:
    """Typed records of a line stream: the same row functions as in batch."""
    return read_records(lines)


def stream_dedupe(records: DataFrame, keys: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """Each id once across replays; with a watermark, state is bounded by it."""
    if watermark is None:
        return records.dropDuplicates(keys)
    return records.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)


def rebuild(folded: DataFrame, lines: DataFrame) -> DataFrame:
    """Finished session rows, from all their lines, of the sessions that a fold has reported for recompute."""
    paths = folded.filter("needs_recompute").select("path").distinct()
    theirs = read_records(lines.join(paths, "path", "left_semi"))
    return build_sessions(materialize(theirs, "recomputed"))


def stream_bursts(records: DataFrame, keys: list[str], ts: str, gap: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """Activity bursts: records no further apart than ``gap`` belong together."""
    timed = records.withWatermark(ts, watermark) if records.isStreaming else records
    return timed.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n")
    ).select(*keys, "start", "end", "n", ((F.unix_micros("end") - F.unix_micros("start")) / 1e6).alias("seconds"))


def closed_sessions(records: DataFrame, keys: list[str], ts: str, idle: str = "6 hours", watermark: str = "1 hour") -> DataFrame:
    """Sessions idle for longer than ``idle``: emitted once the watermark passes them."""
    return stream_bursts(records, keys, ts, idle, watermark).withColumnRenamed("end", "latest_at")


def continued_sessions(records: DataFrame) -> DataFrame:
    """Sessions continued elsewhere are closed at once, however lately they were active: (path, continued_in)."""
    return records.filter("rtype = 'continued-in' and continued_in is not null").select("path", "continued_in").dropDuplicates(["path"])


def stream_counters(records: DataFrame) -> DataFrame:
    """Order-free session counters; combined before the shuffle, so a hot session is spread."""
    return records.groupBy("path").agg(
        count_if(F.col("is_human")).alias("human_turns"), count_if(F.col("interrupt").isNotNull()).alias("interrupts"),
        count_if(F.col("denial") == "user").alias("denied_user"), count_if(F.col("denial") == "plan").alias("denied_plan"),
        count_if(F.col("denial") == "auto").alias("denied_auto"), count_if(F.col("is_steering")).alias("steering"),
        F.min("ts").alias("started_at"), F.max("ts").alias("latest_at"), F.count("*").alias("records"),
    )


class Publisher:
    """``foreachBatch`` body: publish a batch's table on change or heartbeat."""

    def __init__(self, path: str, heartbeat: int = 600):
        self.path, self.heartbeat, self.last = path, heartbeat, None

    def __call__(self, batch: DataFrame, _batch_id: int) -> None:
        self.last = publish_if_changed(batch, self.path, self.last, datetime.now(timezone.utc), self.heartbeat)
