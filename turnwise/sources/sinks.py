"""Published outputs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise import fixed


def overwrite_machine_partition(df: DataFrame, path: str) -> None:
    """Replace only the partitions of the machines in ``df``; others keep theirs."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("machine").parquet(path)


def write_metrics_feed(sessions: DataFrame, lifetime: DataFrame, meta: DataFrame, root: str) -> None:
    """A machine's sessions, lifetime counters and metadata as partitioned tables."""
    overwrite_machine_partition(sessions, f"{root}/sessions")
    overwrite_machine_partition(lifetime, f"{root}/lifetime")
    overwrite_machine_partition(meta, f"{root}/meta")


def nested_progress(projects: DataFrame, stages: DataFrame, subtasks: DataFrame) -> DataFrame:
    """The tree form: to-dos inside stages, stages inside projects.  Nesting happens only here."""
    todo = F.struct("pos", "subtask_key", "text", "status")
    todos = subtasks.groupBy("project_key", "stage_key").agg(F.array_sort(F.collect_list(todo)).alias("subtasks"))
    full = stages.join(todos, ["project_key", "stage_key"], "left")
    inner = [c for c in full.columns if c not in ("project_key", "machine", "project", "root")]
    packed = full.groupBy("project_key").agg(F.collect_list(F.struct(*inner)).alias("stage_list"))
    return projects.join(packed, "project_key", "left")


def write_progress_feed(projects: DataFrame, stages: DataFrame, subtasks: DataFrame, path: str) -> None:
    nested_progress(projects, stages, subtasks).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("machine").json(path)


def content_hash(df: DataFrame, ignore: tuple[str, ...] = ("generated_utc",)) -> str:
    """Order-insensitive identity of a table's rows; one small aggregate row reaches the driver."""
    h = F.xxhash64(*[F.col(c) if not _has_map(df, c) else F.to_json(c) for c in df.columns if c not in ignore])
    r = df.select(h.alias("h")).agg(
        F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("s")
    ).first()
    return f"{r.n}:{r.x}:{r.s}"


def _has_map(df: DataFrame, column: str) -> bool:
    return "map<" in df.schema[column].dataType.simpleString()


def publish_if_changed(
    df: DataFrame, path: str, last: tuple[str, datetime] | None, now: datetime, heartbeat: int = fixed.HEARTBEAT_SECONDS
) -> tuple[str, datetime]:
    """Overwrite ``path`` when the content changed or the heartbeat is due; give the new state back."""
    digest = content_hash(df)
    if last and last[0] == digest and now - last[1] < timedelta(seconds=heartbeat):
        return last
    overwrite_machine_partition(df, path)
    return digest, now


def write_rejects(validated: DataFrame, path: str, batch: str | None = None) -> None:
    """Rejected verdicts with every reason; a ``batch`` that is written again replaces itself."""
    rejected = validated.filter(F.size("problems") > 0)
    if batch is None:
        rejected.write.mode("append").json(path)
    else:
        rejected.write.mode("overwrite").json(f"{path}/batch={batch}")
