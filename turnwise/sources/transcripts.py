"""Transcript files to numbered lines."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.session import materialize

SUBAGENT_GLOBS = ("*/*/subagents/agent-*.jsonl", "*/*/subagents/workflows/*/agent-*.jsonl")


def with_line_no(raw: DataFrame) -> DataFrame:
    """Number the lines of each file in file order, from 0.

    ``raw`` has ``path, block, pos, value``: the file, where its split starts,
    and a position that grows by one from line to line of the split.  The lines
    are written where they were read; a row for each split (its first position
    and what comes before it in the file) is all that is aggregated and joined.
    """
    raw = materialize(raw, "lines")
    splits = raw.groupBy("path", "block").agg(F.min("pos").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("path", "block", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    return raw.join(materialize(offsets, "splits"), ["path", "block"]).select("path", (F.col("pos") + F.col("__shift")).alias("line_no"), "value")


def read_lines(spark: SparkSession, *globs: str) -> DataFrame:
    """Lines of all matching files as ``(path, line_no, value)``; no match is an empty table."""
    raw = None
    for glob in globs:
        folder, _, pattern = glob.rpartition("/")
        frame = if_there(lambda: spark.read.option("ignoreMissingFiles", "true").option("pathGlobFilter", pattern).text(folder))
        if frame is None:
            continue
        # Blank lines go before positions are given, so that a split's positions have no gaps.
        one = frame.select(
            F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value"
        ).filter("value != ''").select("path", "block", F.monotonically_increasing_id().alias("pos"), "value")
        raw = one if raw is None else raw.unionByName(one)
    if raw is None:
        return spark.createDataFrame([], "path STRING, line_no BIGINT, value STRING")
    return with_line_no(raw)


def if_there(read) -> DataFrame | None:
    """What ``read`` gives, or None if its path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """Main transcripts: files directly inside a project folder."""
    return read_lines(spark, f"{root}/*/*.jsonl")


def read_subagent_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """Delegated transcripts, with the session they belong to as ``parent_sid``."""
    lines = read_lines(spark, *[f"{root}/{g}" for g in SUBAGENT_GLOBS])
    return lines.withColumn("parent_sid", F.regexp_extract("path", "([^/]+)/subagents/", 1))


def attach_agent_type(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """Add ``agent_type`` from the sidecar file beside each transcript; null without one."""
    reader = spark.read.schema("agentType STRING").option("multiLine", "true")
    meta = None
    for glob in SUBAGENT_GLOBS:
        found = if_there(lambda g=glob: reader.json(f"{root}/{g.replace('.jsonl', '.meta.json')}"))
        if found is not None:
            one = found.select(
                F.regexp_replace(F.col("_metadata.file_path"), "\\.meta\\.json$", ".jsonl").alias("path"), F.col("agentType").alias("agent_type")
            )
            meta = one if meta is None else meta.unionByName(one)
    if meta is None:
        return files.withColumn("agent_type", F.lit(None).cast("string"))
    return files.join(meta, "path", "left")
