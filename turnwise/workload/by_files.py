"""Queries over what is written as files or lines first: ingest, delegated work, to-do lists."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise import fixed
from turnwise.functions import text as X
from turnwise.operators import progress as P, records as R, sessions as S
from turnwise.session import materialize, scratch_root
from turnwise.sources import transcripts
from turnwise.workload import oracle as O, silver
from turnwise.workload.adapter import event_facts, event_lines, load

QUERIES: dict = {}
ORACLE: dict = {}
FOLDERS = 8


def query(name: str, sql: str):
    def register(fn):
        QUERIES[name] = fn
        ORACLE[name] = sql
        return fn

    return register


def session_of(path: Column) -> Column:
    return F.regexp_extract(path, "([0-9]+)\\.jsonl$", 1).cast("bigint")


def write_transcripts(spark: SparkSession, sf_dir: str) -> str:
    """The event lines as text files, several sessions to a file, with lines between them that must not count."""
    lines = event_lines(load(spark, sf_dir, "events")).withColumn("session", session_of(F.col("path")))
    noise = (
        F.when(F.col("line_no") % 14 == 0, F.array(F.col("value"), F.lit("")))
        .when(F.col("line_no") % 10 == 0, F.array(F.lit('{"type":"summary","message":"nothing"}'), F.col("value")))
        .when(F.col("line_no") % 6 == 0, F.array(F.col("value"), F.lit('{"type":"user", broken')))
        .otherwise(F.array("value"))
    )
    rows = lines.select((F.col("session") % FOLDERS).alias("folder"), "session", "line_no", F.posexplode(noise).alias("i", "value"))
    folder = f"{scratch_root(spark)}/turnwise/transcripts-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    ordered = rows.repartition("folder").sortWithinPartitions("folder", "session", "line_no", "i")
    ordered.select("folder", "value").write.mode("overwrite").partitionBy("folder").text(folder)
    return folder


@query(
    "ingest_files",
    f"""WITH {O.FACTS}, n AS (SELECT session, sum(CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END) AS n_records,
        count(*) FILTER (event_type = 'view') AS n_human FROM facts GROUP BY session),
      k AS (SELECT session, md5(string_agg(CAST(k AS VARCHAR), ',' ORDER BY event_id)) AS wording FROM facts WHERE event_type = 'view' GROUP BY session)
      SELECT session, CAST(n_records AS BIGINT) AS n_records, n_human, wording FROM n LEFT JOIN k USING (session)""",
)
def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to numbered lines to records: every line once, in file order, unreadable and irrelevant ones left out."""
    lines = transcripts.read_lines(spark, f"{write_transcripts(spark, sf_dir)}/*/*.txt")
    records = R.read_records(lines).filter("rtype is not null").select("path", "line_no", "sid", "is_human", F.regexp_extract("text", "work k([0-9]+) on", 1).alias("k"))
    spoken = F.array_sort(F.collect_list(F.when(F.col("is_human"), F.struct("path", "line_no", "k"))))
    per = records.groupBy(F.substring("sid", 2, 20).cast("bigint").alias("session")).agg(
        F.count("*").alias("n_records"), F.count_if("is_human").alias("n_human"), spoken.alias("spoken")
    )
    wording = F.md5(F.array_join(F.transform("spoken", lambda s: s["k"]), ",").cast("binary"))
    return per.select("session", "n_records", "n_human", F.when(F.size("spoken") > 0, wording).alias("wording"))


@query(
    "ingest_numbering",
    f"""WITH {O.FACTS}, l AS (SELECT session, event_id * 2 AS line_no FROM facts UNION ALL SELECT session, event_id * 2 + 1 FROM facts WHERE event_type = 'purchase'),
      c AS (SELECT session % {FOLDERS} AS folder, CASE WHEN line_no % 14 = 0 THEN 1 WHEN line_no % 10 = 0 OR line_no % 6 = 0 THEN 2 ELSE 1 END AS n FROM l)
      SELECT folder, CAST(sum(n) AS BIGINT) AS lines, 0::BIGINT AS first_no, CAST(sum(n) - 1 AS BIGINT) AS last_no, CAST(sum(n) AS BIGINT) AS numbers FROM c GROUP BY folder""",
)
def ingest_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of a file are 0, 1, 2, ... without gaps; blank lines have none."""
    lines = transcripts.read_lines(spark, f"{write_transcripts(spark, sf_dir)}/*/*.txt")
    return lines.groupBy(F.regexp_extract("path", "folder=([0-9]+)", 1).cast("bigint").alias("folder")).agg(
        F.count("*").alias("lines"), F.min("line_no").alias("first_no"), F.max("line_no").alias("last_no"), F.countDistinct("line_no").alias("numbers")
    )


_SUB = f"""{O.FACTS}, {O.CALLS}, s AS (SELECT DISTINCT session, session % 11 AS parent FROM facts),
  u AS (SELECT session % 11 AS parent, sum(tin + cc5 + cc1h + cr + tout) AS tokens, count(*) AS calls FROM calls GROUP BY 1),
  t AS (SELECT session % 11 AS parent, count(*) AS tool_calls FROM facts WHERE event_type = 'purchase' GROUP BY 1)"""


def _delegated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session as delegated work of one of eleven parents, every third of an unnamed kind."""
    records = silver.records(spark, sf_dir)
    session = session_of(F.col("path"))
    files = records.select("path").distinct().select(
        "path", F.concat(F.lit("p"), (session % 11).cast("string")).alias("parent_sid"), F.when(session % 3 != 0, F.concat(F.lit("kind"), (session % 3).cast("string"))).alias("agent_type")
    )
    return S.subagent_totals(files, records)


@query(
    "delegated_rollup",
    f"""WITH {_SUB} SELECT 'p' || CAST(parent AS VARCHAR) AS parent_sid, count(*) AS n, count(*) FILTER (session % 3 = 0) AS unknown_kind, count(*) FILTER (session % 3 = 1) AS kind1,
      CAST(any_value(coalesce(tool_calls, 0)) AS BIGINT) AS tool_calls, CAST(any_value(coalesce(tokens, 0)) AS BIGINT) AS tokens
      FROM s LEFT JOIN u USING (parent) LEFT JOIN t USING (parent) GROUP BY parent""",
)
def delegated_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = S.rollup_subagents(materialize(_delegated(spark, sf_dir), "delegated"))
    kind = lambda name: F.coalesce(F.try_element_at("by_type", F.lit(name)), F.lit(0))
    return rolled.select("parent_sid", "n", kind("unknown").alias("unknown_kind"), kind("kind1").alias("kind1"), "tool_calls", S.tokens_of(F.col("by_model")).alias("tokens"))


@query(
    "delegated_attached",
    f"""WITH {_SUB} SELECT DISTINCT s.session, CASE WHEN s.session < 11 THEN n END AS delegated FROM s LEFT JOIN (SELECT parent, count(*) AS n FROM s GROUP BY parent) c ON c.parent = s.session""",
)
def delegated_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = S.rollup_subagents(materialize(_delegated(spark, sf_dir), "delegated")).withColumn("parent_sid", F.regexp_replace("parent_sid", "^p", "s"))
    joined = S.attach_subagents(silver.sessions(spark, sf_dir), rolled)
    return joined.select(session_of(F.col("path")).alias("session"), F.col("subagents.n").alias("delegated"))


@query(
    "tool_families",
    f"""WITH {O.FACTS} SELECT session, CASE k % 5 WHEN 0 THEN 'shell' WHEN 1 THEN 'edit' WHEN 2 THEN 'ask' WHEN 4 THEN 'skill' END AS family, count(*) AS calls
      FROM facts WHERE event_type = 'purchase' GROUP BY 1, 2""",
)
def tool_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = R.explode_blocks(silver.records(spark, sf_dir).filter("rtype = 'assistant'")).filter("btype = 'tool_use'")
    return uses.groupBy(session_of(F.col("path")).alias("session"), R.tool_family(F.col("tool_name")).alias("family")).agg(F.count("*").alias("calls"))


def todo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as to-do calls (purchases), titles (sign-ups) and plain turns."""
    e = event_facts(load(spark, sf_dir, "events"))
    k = F.col("k")
    item = lambda text, status: F.struct(text.alias("content"), status.alias("status"))
    todos = F.array(
        item(F.format_string("step  %d", k), F.when(k % 2 == 0, "completed").otherwise("pending")),
        item(F.format_string("listed-value-%07d and more", k), F.when(k % 3 == 0, "completed").otherwise("in_progress")),
    )
    common = [
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.concat(F.lit("s"), F.col("session").cast("string")).alias("sessionId"),
        F.concat(F.lit("/home/u/p"), (F.col("session") % 7).cast("string"), F.lit("/deep")).alias("cwd"),
    ]
    call = F.struct(F.lit("tool_use").alias("type"), F.lit("t").alias("id"), F.lit(fixed.TODO_TOOL).alias("name"), F.struct(todos.alias("todos")).alias("input"))
    value = (
        F.when(F.col("event_type") == "purchase", F.to_json(F.struct(F.lit("assistant").alias("type"), *common, F.struct(F.array(call).alias("content")).alias("message"))))
        .when(F.col("event_type") == "signup", F.to_json(F.struct(F.lit("ai-title").alias("type"), *common, F.format_string("Title %d of listed-value-%07d", k, k).alias("aiTitle"))))
        .otherwise(F.to_json(F.struct(F.lit("user").alias("type"), *common, F.struct(F.lit("hello").alias("content")).alias("message"))))
    )
    return e.select(F.format_string("/logs/p/%012d.jsonl", "session").alias("path"), F.col("event_id").alias("line_no"), value.alias("value"))


def _progress(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    latest = materialize(P.latest_progress(R.read_records(todo_lines(spark, sf_dir), P.PROGRESS_MARKERS)), "todo_latest")
    roots = P.project_root(latest.select("cwd"), latest.select(F.regexp_extract("cwd", "^/home/u/p[0-2]", 0).alias("root")).filter("root <> ''").distinct(), "/home/u")
    live = latest.filter(session_of(F.col("path")) % 4 == 0).select(
        F.col("sid").alias("sessionId"), "cwd", F.lit(1767225600000.0).alias("startedAt"), F.concat(F.lit("run "), "sid").alias("name")
    )
    # Every third listed value is denied; so titles and to-dos that hold one are redacted.
    deny = event_facts(load(spark, sf_dir, "events")).filter("k % 3 = 0").select(F.format_string("listed-value-%07d", "k").alias("value"))
    return P.build_progress(latest, roots, live, "m", deny)


_TODO = f"""{O.FACTS}, td AS (SELECT session, arg_max(k, event_id) AS k FROM facts WHERE event_type = 'purchase' GROUP BY session),
  ti AS (SELECT session, arg_max(k, event_id) AS tk FROM facts WHERE event_type = 'signup' GROUP BY session),
  ps AS (SELECT DISTINCT session FROM facts WHERE event_type <> 'signup')"""


@query(
    "todo_stages",
    f"""WITH {_TODO} SELECT session, CASE WHEN tk IS NOT NULL THEN 'Title ' || tk || ' of ' || CASE WHEN tk % 3 = 0 THEN '{fixed.REDACTED}' ELSE printf('listed-value-%07d', tk) END
        WHEN session % 4 = 0 THEN 'run s' || session ELSE '{fixed.UNTITLED}' END AS title,
      'p' || session % 7 AS project, 'deep' AS subpath, session % 4 = 0 AS running,
      CASE WHEN k IS NULL THEN 0 ELSE 2 END::BIGINT AS num_todos, CASE WHEN k IS NULL THEN 0 ELSE (k % 2 = 0)::INT + (k % 3 = 0)::INT END::BIGINT AS num_done
      FROM ps LEFT JOIN td USING (session) LEFT JOIN ti USING (session)""",
)
def todo_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest to-do list and title of every session, live names, project places; redacted by pattern and list."""
    stages, _ = _progress(spark, sf_dir)
    return stages.select(F.substring("stage_key", 2, 20).cast("bigint").alias("session"), "title", "project", "subpath", "running", "num_todos", "num_done")


@query(
    "todo_subtasks",
    f"""WITH {_TODO}, x AS (SELECT session, k FROM td JOIN ps USING (session)) SELECT session, 0 AS pos, 'step  ' || k AS text, CASE WHEN k % 2 = 0 THEN 'completed' ELSE 'pending' END AS status FROM x
      UNION ALL SELECT session, 1, CASE WHEN k % 3 = 0 THEN '{fixed.REDACTED}' ELSE printf('listed-value-%07d', k) END || ' and more', CASE WHEN k % 3 = 0 THEN 'completed' ELSE 'in_progress' END FROM x""",
)
def todo_subtasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, subtasks = _progress(spark, sf_dir)
    return subtasks.select(F.substring("stage_key", 2, 20).cast("bigint").alias("session"), "pos", "text", "status")


@query(
    "feed_window",
    f"""WITH {O.FACTS}, l AS (SELECT session, max(ts) AS latest FROM facts GROUP BY session) SELECT session FROM l WHERE latest >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY""",
)
def feed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.recent(silver.sessions(spark, sf_dir), F.lit("2024-01-31 00:00:00").cast("timestamp"), 10).select(session_of(F.col("path")).alias("session"))


@query(
    "session_kinds",
    "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'judge' END AS kind FROM documents",
)
def session_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening texts, every fifth of them behind the review command."""
    docs = load(spark, sf_dir, "documents")
    opening = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("  /Judge-Sessions "), "text")).otherwise(F.col("text"))
    return docs.select("doc_id", X.session_kind(opening).alias("kind"))


@query(
    "review_cost",
    f"""WITH {O.SESSIONS} SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) AS judge_tokens FROM sess WHERE session % 5 = 0""",
)
def review_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the sessions (every fifth) that count as reviewing ones."""
    kind = F.when(session_of(F.col("path")) % 5 == 0, "judge")
    return S.review_cost(silver.sessions(spark, sf_dir).withColumn("kind", kind))
