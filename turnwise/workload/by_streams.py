"""Queries over what streams write: the event log as growing transcript files, followed, folded, closed, counted and published."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators.records import read_records
from turnwise.operators.sessions import tokens_of
from turnwise.session import materialize, scratch_root, share_package
from turnwise.sources import snapshots
from turnwise.streaming import closing, counters, ledger, tail, upkeep, whole_fold
from turnwise.workload import oracle as O
from turnwise.workload.adapter import event_facts, event_lines, load

QUERIES: dict = {}
ORACLE: dict = {}
PATTERN = "*/*.txt"
NOW = datetime(2026, 1, 1)


def query(name: str, sql: str):
    def register(fn):
        QUERIES[name] = fn
        ORACLE[name] = sql
        return fn

    return register


def _folder(spark: SparkSession, name: str) -> str:
    root = scratch_root(spark)
    return f"{root}/turnwise/{name}-{uuid.uuid4().hex}"


def _session(path: str = "path") -> Column:
    return F.regexp_extract(path, "session=([0-9]+)", 1).cast("bigint")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, line_no, value) of the event log, and where a session goes on in the next one, a line that says so."""
    lines = event_lines(load(spark, sf_dir, "events")).select(F.regexp_extract("path", "([0-9]+)\\.jsonl$", 1).cast("bigint").alias("session"), "line_no", "value")
    facts = event_facts(load(spark, sf_dir, "events")).select("session").distinct().where("session % 3 = 0 and session div 3 % 3 <> 0")
    onward = F.to_json(F.struct(F.lit("continued-in").alias("type"), F.concat(F.lit("s"), (F.col("session") + 1).cast("string")).alias("continuedInSessionId")))
    return lines.unionByName(facts.select("session", F.lit(1 << 60).alias("line_no"), onward.alias("value")))


def _write(lines: DataFrame, folder: str) -> None:
    """A file for every session, its lines in order.

    Tasks write the files as sessions come by: a table partitioned by session would cost a folder, two files and their permissions each,
    many times the time of the lines.  A file gets its name when it is whole, so a task that runs again leaves the same files.
    """
    name = uuid.uuid4().hex

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base, _ = tail._open(folder)
        draft, at, out, n = f"{uuid.uuid4().hex}.tmp", None, None, 0

        def finish() -> None:
            if out is not None:
                out.close()
                store.move(f"{at}/{draft}", f"{at}/{name}.txt")

        for batch in batches:
            rows = zip(batch.column("session").to_pylist(), batch.column("value").to_pylist(), strict=True)
            for session, part in groupby(rows, itemgetter(0)):
                place = f"{base}/session={'__HIVE_DEFAULT_PARTITION__' if session is None else session}"
                if place != at:
                    finish()
                    at, n = place, n + 1
                    store.create_dir(at, recursive=True)
                    out = store.open_output_stream(f"{at}/{draft}")
                out.write("".join([f"{value or ''}\n" for _, value in part]).encode())
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    ordered = lines.repartition("session").sortWithinPartitions("session", "line_no")
    ordered.select("session", "value").mapInArrow(written, "files bigint").write.format("noop").mode("overwrite").save()


def _follow(df: DataFrame, checkpoint: str, body: Callable[[DataFrame, int], None]) -> list:
    """Run a stream over what is there; its progress reports."""
    q = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(body).trigger(availableNow=True).start()
    q.awaitTermination()
    return list(q.recentProgress)


def _two_runs(spark: SparkSession, sf_dir: str, name: str, run: Callable[[str, int], None]) -> str:
    """Write the even sessions' files, run, add the odd ones', run again; the folder of the files."""
    share_package(spark)
    folder, lines = _folder(spark, name), _lines(spark, sf_dir)
    for part in (0, 1):
        _write(lines.where(F.col("session") % 2 == part), folder)
        run(folder, part)
    return folder


_N_LINES = f"""{O.FACTS}, s AS (SELECT session, sum(CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END) AS n FROM facts GROUP BY session),
  t AS (SELECT session, n + CASE WHEN session % 3 = 0 AND session // 3 % 3 <> 0 THEN 1 ELSE 0 END AS n FROM s)"""


@query("stream_tailed_lines", f"WITH {_N_LINES} SELECT session, CAST(n AS BIGINT) AS n_lines, CAST(session % 2 AS BIGINT) AS batch, 0::BIGINT AS gap_bytes, 0::BIGINT AS generation FROM t")
def stream_tailed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growing files followed in two runs: every line once, in the run after it was written, ranges end to end."""
    out, checkpoint = _folder(spark, "tailed"), _folder(spark, "tailed_state")

    def body(batch: DataFrame, number: int) -> None:
        kept = batch.select("path", "generation", "line_no", "upto", F.col("value").isNotNull().alias("is_line"), F.lit(number).cast("bigint").alias("batch"))
        kept.write.mode("overwrite").parquet(f"{out}/batch={number}")

    _two_runs(spark, sf_dir, "tailed_files", lambda folder, _: _follow(tail.stream_lines(spark, folder, PATTERN, f"{checkpoint}/positions"), f"{checkpoint}/query", body))
    seen = spark.read.schema("path string, generation bigint, line_no bigint, upto bigint, is_line boolean").option("basePath", out).parquet(f"{out}/batch=*").withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), "batch=([0-9]+)", 1).cast("bigint"))
    gap = F.max("upto") - F.sum(F.col("upto") - F.when(F.col("upto").isNotNull(), F.col("line_no")))
    return seen.groupBy(_session().alias("session")).agg(F.count_if("is_line").alias("n_lines"), F.max("batch").alias("batch"), gap.alias("gap_bytes"), F.max("generation").alias("generation"))


_MAYBE = ("first_correction_turn", "first_ask_turn")
_FOLDED = ("human_turns", "askuser", "tool_calls_total", "interrupts", "denied_user", "denied_plan", "steering", "lex_corrections", "reexplain", "reexplain_after_compaction",
           "turns_after_compaction", "interrupts_after_compaction", "cache_resets", "ctx_peak", "ctx_final", "tests_run", "git_commits")


@query(
    "stream_kept_sessions",
    f"WITH {O.SESSIONS} SELECT session, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _FOLDED)}, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in _MAYBE)}, CAST(n_compactions AS BIGINT) AS n_compactions, CAST(tokens AS BIGINT) AS tokens FROM sess",
)
def stream_kept_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions folded record by record and kept in a table that changes batch by batch."""
    out, checkpoint = _folder(spark, "kept"), _folder(spark, "kept_state")

    def run(folder: str, _part: int) -> None:
        lines = tail.stream_lines(spark, folder, PATTERN, f"{checkpoint}/positions")
        _follow(whole_fold.stream_sessions(lines), f"{checkpoint}/query", upkeep.Upkeep(folder, out, "all", buckets=8))

    _two_runs(spark, sf_dir, "kept_files", run)
    kept = upkeep.sessions(spark, out, "all")
    return kept.select(_session().alias("session"), *_FOLDED, *[F.coalesce(c, F.lit(0)).alias(c) for c in _MAYBE], F.size("compactions").cast("bigint").alias("n_compactions"), F.coalesce(tokens_of(F.col("by_model")), F.lit(0)).alias("tokens"))


@query(
    "stream_closed_sessions",
    f"""WITH {O.FACTS}, s AS (SELECT session, max(ts) AS latest, session % 3 = 0 AND session // 3 % 3 <> 0 AS onward FROM facts GROUP BY session), w AS (SELECT max(ts) AS top FROM facts)
      SELECT session, CASE WHEN onward THEN 'continued' ELSE 'idle' END AS cause, CASE WHEN onward THEN 's' || CAST(session + 1 AS VARCHAR) END AS continued_in
      FROM s, w WHERE onward OR latest + INTERVAL 6 HOUR < top - INTERVAL 1 HOUR""",
)
def stream_closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that went on elsewhere or fell idle, each once."""
    share_package(spark)
    folder, out, checkpoint = (_folder(spark, f"closed{x}") for x in ("_files", "", "_state"))
    untimed = spark.createDataFrame([(1 << 40, 0, '{"type":"user","sessionId":"last"}')], "session bigint, line_no bigint, value string")
    # Time moves on with each batch; the second one, of a line without a time, lets the timers of the first fire.
    for lines in (_lines(spark, sf_dir), untimed):
        _write(lines, folder)
        followed = tail.stream_lines(spark, folder, PATTERN, f"{checkpoint}/positions").where("value is not null")
        _follow(closing.stream_closed(read_records(followed)), f"{checkpoint}/query", lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
    return spark.read.parquet(f"{out}/batch=*").select(_session().alias("session"), "cause", "continued_in")


@query(
    "stream_calls_once",
    f"WITH {O.FACTS}, {O.CALLS} SELECT session, count(*) AS calls, CAST(sum(tin + cc5 + cc1h + cr + tout) AS BIGINT) AS tokens FROM calls GROUP BY session",
)
def stream_calls_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API calls by message id over batches that replay ids: the first record of each, as the ledger has it."""
    share_package(spark)
    root, out = _folder(spark, "ids"), _folder(spark, "calls")
    ids = ledger.Ledger(root, "all", ["path", "msg_id"], buckets=8)
    records = read_records(event_lines(load(spark, sf_dir, "events"))).where("rtype = 'assistant' and msg_id is not null").select("path", "line_no", "msg_id", "usage")
    records = materialize(records, "call_records")  # every batch reads them
    edges = records.agg(F.percentile_approx("line_no", [0.34, 0.67])).first()[0]
    for number, (low, high) in enumerate(zip([0, *edges], [*edges, 1 << 62], strict=True)):
        batch = records.where((F.col("line_no") >= low) & (F.col("line_no") < high))
        ids.fresh(batch, number, ["line_no"]).write.mode("overwrite").parquet(f"{out}/batch={number}")
    u = F.col("usage")
    once = spark.read.parquet(f"{out}/batch=*")
    return once.groupBy(F.regexp_extract("path", "([0-9]+)\\.jsonl$", 1).cast("bigint").alias("session")).agg(
        F.count("*").alias("calls"), F.sum(u["in_tokens"] + u["cc5"] + u["cc1h"] + u["cr"] + u["out"]).alias("tokens")
    )


@query(
    "stream_ingest_health",
    f"""WITH {O.FACTS}, l AS (SELECT event_id * 2 AS n FROM facts UNION ALL SELECT event_id * 2 + 1 FROM facts WHERE event_type = 'purchase'),
      c AS (SELECT count(*) AS own, count(*) FILTER (n % 14 <> 0 AND n % 10 = 0) AS odd, count(*) FILTER (n % 14 <> 0 AND n % 10 <> 0 AND n % 6 = 0) AS bad FROM l)
      SELECT own + odd + bad AS lines, own + bad AS relevant, own AS records, bad, 0::BIGINT AS late, round(1 - round((own + bad) / (own + odd + bad), 6), 6) AS filtered_share, round(bad / (own + bad), 6) AS bad_share FROM c""",
)
def stream_ingest_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read, left out and lost, counted on the stream's own pass; files hold irrelevant and broken lines too."""
    from turnwise.workload.by_files import write_transcripts

    share_package(spark)
    folder, checkpoint = write_transcripts(spark, sf_dir), _folder(spark, "health_state")
    lines = tail.stream_lines(spark, folder, PATTERN, f"{checkpoint}/positions").where("value is not null")
    reports = _follow(counters.observed_records(lines), f"{checkpoint}/query", lambda batch, _: batch.write.format("noop").mode("overwrite").save())
    health = counters.ingest_health(spark.createDataFrame([counters.metric_row(p) for p in reports if p.numInputRows], counters.METRICS))
    return health.select("lines", "relevant", "records", "bad", "late", F.round("filtered_share", 6).alias("filtered_share"), "bad_share")


@query(
    "published_snapshots",
    f"""WITH {O.FACTS}, s AS (SELECT machine, session, count(*) AS n FROM facts GROUP BY ALL)
      SELECT 'm' || CAST(machine AS VARCHAR) AS machine, count(*) FILTER (machine < 2) AS sessions, coalesce(CAST(sum(n) FILTER (machine < 2) AS BIGINT), 0) AS events, CAST(CASE WHEN machine = 0 THEN 1 ELSE 2 END AS BIGINT) AS version
      FROM s GROUP BY machine""",
)
def published_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three machines publish twice: one without a change, one with new rows, one that has nothing left."""
    root = _folder(spark, "feeds")
    facts = event_facts(load(spark, sf_dir, "events")).groupBy("machine", "session").agg(F.count("*").alias("n"))
    for step in (0, 1):
        for machine in range(3):
            own = facts.where(F.col("machine") == machine).select(F.lit(f"m{machine}").alias("machine"), "session", "n")
            own = own.where({0: "true", 1: "session % 2 = 0" if step == 0 else "true", 2: "true" if step == 0 else "false"}[machine])
            total = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events")).select(F.lit(f"m{machine}").alias("machine"), "events")
            snapshots.publish({"sessions": own, "lifetime": total}, root, f"m{machine}", NOW + timedelta(seconds=step))
    there = snapshots.owners(spark, root)
    versions = spark.createDataFrame([(s.owner, s.version) for s in there], "machine string, version bigint")
    sessions = snapshots.read(spark, there, "sessions").groupBy("machine").agg(F.count("*").alias("sessions"))
    totals = snapshots.read(spark, there, "lifetime").join(versions, "machine").join(sessions, "machine", "left")
    return totals.select("machine", F.coalesce("sessions", F.lit(0)).alias("sessions"), "events", "version")
