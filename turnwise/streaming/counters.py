"""Counters of what a pass over lines read, left out and lost, taken on that pass.

``observed_records`` reads records as :func:`turnwise.operators.records.read_records` does and counts as the rows go by: all lines, those that
can matter, those that could be read, those that could not.  In a batch, ``Observation`` objects give the numbers; in a stream they come with each
progress report, where Spark also says how many rows came too late for the watermark.  ``Metrics`` puts both into a table, a row per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from turnwise import fixed
from turnwise.operators import records as R

LINES, PARSED = "turnwise_lines", "turnwise_parsed"
METRICS = "query STRING, run STRING, batch BIGINT, at STRING, lines BIGINT, relevant BIGINT, records BIGINT, bad BIGINT, late BIGINT"


def observed_records(lines: DataFrame, counted: Observation | str = LINES, parsed: Observation | str = PARSED, carry: tuple[str, ...] = (), unread: bool = False) -> DataFrame:
    """Records of ``lines``; the observation ``counted`` holds ``lines``, ``parsed`` holds ``relevant``, ``records`` and ``bad``."""
    seen = lines.observe(counted, F.count("value").alias("lines"))
    relevant = R.prefilter_lines(seen, fixed.LINE_MARKERS, unread)
    whole = R.with_fields(relevant)
    there = F.col("value").isNotNull()
    whole = whole.observe(parsed, F.count("value").alias("relevant"), F.count_if(R.readable()).alias("records"), F.count_if(there & ~R.readable()).alias("bad"))
    return R.to_records(R.keep_readable(whole, unread), carry)


def metric_row(progress) -> tuple:
    """A progress report as a row of ``METRICS``."""
    found: dict = {}
    for name in (LINES, PARSED):
        row = progress.observedMetrics.get(name)
        found |= row.asDict() if row is not None else {}
    late = sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)
    return progress.name, str(progress.runId), progress.batchId, progress.timestamp, *(found.get(c) for c in ("lines", "relevant", "records", "bad")), late


class Metrics(StreamingQueryListener):
    """Appends a row (see ``METRICS``) to a folder for each micro-batch of each query that had input; ``spark.streams.addListener`` it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = metric_row(event.progress)
        if event.progress.numInputRows or row[-1]:
            self.spark.createDataFrame([row], METRICS).coalesce(1).write.mode("append").json(self.folder)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that :class:`Metrics` wrote."""
    return spark.read.schema(METRICS).json(folder)


def ingest_health(metrics: DataFrame) -> DataFrame:
    """Per query: batches, lines, shares left out and lost, late rows.  A batch that ran again counts as it ran last."""
    last = metrics.groupBy("query", "batch").agg(F.max_by(F.struct("lines", "relevant", "records", "bad", "late"), "at").alias("m")).select("query", "batch", "m.*")
    total = last.groupBy("query").agg(F.count("*").alias("batches"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("lines", "relevant", "records", "bad", "late")])
    share = lambda part, whole: F.when(F.col(whole) > 0, F.round(F.col(part) / F.col(whole), 6))
    return total.withColumn("filtered_share", 1 - share("relevant", "lines")).withColumn("bad_share", share("bad", "relevant"))
