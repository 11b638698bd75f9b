"""Queries over the order, event and label tables: progress, merging, review, streams in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise import fixed
from turnwise.functions import formats
from turnwise.operators import cohorts, merge, ordered, progress as P, review, sessions as S
from turnwise.operators.ordering import by_number, medians
from turnwise.workload import oracle as O, silver
from turnwise.workload.adapter import event_facts, load

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# --- progress: customer = project, order = stage, line item = to-do, nation = machine


def progress_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders, items = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    cust = load(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("machine"), "c_name")
    status = F.when(F.col("l_returnflag") == "R", "completed").when(
        (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 25), "in_progress"
    ).otherwise("pending")
    todos = items.select(
        F.col("l_orderkey").alias("stage_key"), F.col("l_linenumber").alias("pos"), status.alias("status"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("text"), (F.col("l_suppkey") % 17 == 0).alias("hidden"),
        # Line numbers repeat within an order; the row that was written first is the earlier one.
        F.struct("_metadata.file_path", "_metadata.row_index").alias("place"),
    )
    owner = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("project_key"), F.col("o_orderkey").alias("stage_key"), "machine", F.col("c_name").alias("project"),
        F.concat(F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey").cast("string")).alias("title"),
        (F.col("o_totalprice") > 400000).alias("running"), F.col("o_orderdate").cast("timestamp").alias("latest_at"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"), (F.col("o_orderkey") % 19 == 0).alias("hidden"),
    )
    stages = owner.join(P.todo_progress(todos, ["stage_key"]), "stage_key", "left").fillna(0, ["num_done", "num_todos"]).fillna(False, ["has_doing"])
    stages = P.mark_foreground(stages)
    projects = P.project_rollup(stages).withColumn("hidden", F.col("project_key") % 23 == 0)
    subtasks = todos.join(owner.select("stage_key", "project_key"), "stage_key")
    return projects, stages, subtasks


_PROG = """todo AS (SELECT l_orderkey AS sk, l_linenumber AS pos, CASE WHEN l_returnflag = 'R' THEN 'completed' WHEN l_linestatus = 'O' AND l_quantity > 25 THEN 'in_progress' ELSE 'pending' END AS status,
    'part ' || CAST(l_partkey AS VARCHAR) AS text, l_suppkey % 17 = 0 AS hidden FROM lineitem),
tp AS (SELECT sk, count(*) FILTER (status = 'completed') AS nd, count(*) AS nt, bool_or(status = 'in_progress') AS doing, bool_or(hidden) AS th FROM todo GROUP BY sk),
st AS (SELECT o_custkey AS pk, o_orderkey AS sk, 'n' || CAST(c_nationkey AS VARCHAR) AS machine, c_name AS project, o_orderpriority || ' ' || CAST(o_orderkey AS VARCHAR) AS title,
    o_totalprice > 400000 AS running, o_orderdate AS ts, o_orderkey % 19 = 0 AS hidden, o_custkey % 23 = 0 AS ph,
    coalesce(nd, 0) AS nd, coalesce(nt, 0) AS nt, coalesce(doing, false) AS doing, coalesce(th, false) AS th
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN tp ON tp.sk = o_orderkey),
ss AS (SELECT *, CASE WHEN running THEN 'live' WHEN nt > 0 AND nd = nt THEN 'done' WHEN doing OR nd > 0 THEN 'doing' ELSE 'other' END AS state FROM st)"""


@query("stage_state", f"WITH {_PROG} SELECT sk AS stage_key, state, nd AS num_done, nt AS num_todos FROM ss")
def stage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stages, _ = progress_tables(spark, sf_dir)
    return P.stage_state(stages).select("stage_key", "state", "num_done", "num_todos")


@query(
    "progress_rollup",
    f"""WITH {_PROG} SELECT machine, pk AS project_key, CAST(sum(nt) AS BIGINT) AS num_todos, CAST(sum(nd) AS BIGINT) AS num_done,
      count(*) AS num_stages, count(*) FILTER (running) AS num_active, count(*) FILTER (nt > 0 AND nd = nt) AS num_done_stages,
      epoch_us(max(ts)) AS latest_us, epoch_us(min(ts)) AS started_us FROM st GROUP BY machine, pk""",
)
def progress_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects, _, _ = progress_tables(spark, sf_dir)
    return projects.select(
        "machine", "project_key", "num_todos", "num_done", "num_stages", "num_active", "num_done_stages",
        F.unix_micros("latest_at").alias("latest_us"), F.unix_micros("started_at").alias("started_us"),
    )


@query(
    "todo_progress",
    f"WITH {_PROG} SELECT sk AS stage_key, nd AS num_done, nt AS num_todos, CAST(nd * 1000 // nt AS BIGINT) AS permille FROM tp",
)
def todo_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem")
    todos = items.select(F.col("l_orderkey").alias("stage_key"), F.when(F.col("l_returnflag") == "R", "completed").otherwise("pending").alias("status"))
    out = P.todo_progress(todos, ["stage_key"])
    return out.select("stage_key", "num_done", "num_todos", F.floor(F.col("num_done") * 1000 / F.col("num_todos")).alias("permille"))


@query(
    "overall_counts",
    f"""WITH {_PROG} SELECT count(*) AS projects, count(*) FILTER (a > 0) AS active_projects, CAST(sum(n) AS BIGINT) AS stages
      FROM (SELECT pk, count(*) AS n, count(*) FILTER (running) AS a FROM st GROUP BY pk)""",
)
def overall_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects, _, _ = progress_tables(spark, sf_dir)
    return P.overall_counts(projects)


@query(
    "machine_rollup",
    f"""WITH {_PROG}, pr AS (SELECT machine, pk, any_value(ph) AS ph, max(ts) AS ts FROM st GROUP BY machine, pk),
    own AS (SELECT machine, count(*) AS projects, max(ts) AS ts FROM pr WHERE NOT ph GROUP BY machine),
    per AS (SELECT machine, count(*) FILTER (running AND NOT hidden) AS live, sum(nd) AS nd, sum(nt) AS nt FROM st WHERE NOT ph GROUP BY machine)
    SELECT machine, projects, epoch_us(ts) AS latest_us, live, CAST(nd AS BIGINT) AS num_done, CAST(nt AS BIGINT) AS num_todos FROM own LEFT JOIN per USING (machine)""",
)
def machine_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects, stages, _ = progress_tables(spark, sf_dir)
    return P.machine_rollup(projects, stages).select(
        "machine", "projects", F.unix_micros("latest_at").alias("latest_us"), "live", "num_done", "num_todos"
    )


@query(
    "headline_kpis",
    f"""WITH {_PROG} SELECT round(100.0::DOUBLE * sum(nd) FILTER (NOT hidden) / sum(nt) FILTER (NOT hidden), 6) AS overall_pct,
      count(DISTINCT pk) AS projects, count(*) FILTER (running AND NOT hidden) AS live, count(*) FILTER (NOT hidden) AS stages, count(DISTINCT machine) AS machines
      FROM st WHERE NOT ph""",
)
def headline_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects, stages, _ = progress_tables(spark, sf_dir)
    return P.headline_kpis(projects, stages).select(F.round("overall_pct", 6).alias("overall_pct"), "projects", "live", "stages", "machines")


@query(
    "tab_counts",
    f"""WITH {_PROG}, seen AS (SELECT * FROM ss WHERE NOT ph AND NOT hidden)
    SELECT count(*) AS "all", count(*) FILTER (state = 'live') AS live, count(*) FILTER (state IN ('live', 'doing')) AS doing, count(*) FILTER (state = 'done') AS done,
      (SELECT count(*) FROM ss WHERE hidden) + (SELECT count(DISTINCT pk) FROM ss WHERE ph)
        + (SELECT count(*) FROM todo WHERE hidden AND sk IN (SELECT sk FROM seen)) AS hidden FROM seen""",
)
def tab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tab_counts(*progress_tables(spark, sf_dir))


@query(
    "progress_view",
    f"""WITH {_PROG}, m AS (SELECT sk, bool_or(contains(lower(text), 'part 7')) AS hit FROM todo GROUP BY sk)
      SELECT pk AS project_key, sk AS stage_key FROM ss LEFT JOIN m USING (sk) WHERE NOT ph AND NOT hidden AND state IN ('live', 'doing')
      AND (contains(lower(title), 'part 7') OR contains(lower(project), 'part 7') OR coalesce(hit, false)) AND machine = 'n3'""",
)
def progress_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.progress_view(*progress_tables(spark, sf_dir), state="doing", query="Part 7", machine="n3").select("project_key", "stage_key")


@query(
    "progress_hidden",
    f"WITH {_PROG} SELECT pk AS project_key, sk AS stage_key FROM ss WHERE ph OR hidden OR th",
)
def progress_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.progress_view(*progress_tables(spark, sf_dir), state="hidden").select("project_key", "stage_key")


@query(
    "active_sections",
    f"WITH {_PROG} SELECT machine, pk AS project_key, bool_or(running OR (nt > 0 AND nd < nt)) AS is_active FROM st GROUP BY machine, pk",
)
def active_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stages, _ = progress_tables(spark, sf_dir)
    return P.active_sections(stages)


@query(
    "live_now",
    f"""WITH {_PROG}, cur AS (SELECT sk, arg_min(text, pos) AS current_todo FROM todo WHERE status = 'in_progress' GROUP BY sk)
      SELECT sk AS stage_key, epoch_us(ts) AS latest_us, current_todo FROM st LEFT JOIN cur USING (sk) WHERE running AND NOT hidden AND NOT ph""",
)
def live_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.live_now(*progress_tables(spark, sf_dir)).select("stage_key", F.unix_micros("latest_at").alias("latest_us"), "current_todo")


@query(
    "foreground",
    f"WITH {_PROG} SELECT pk AS project_key, sk AS stage_key FROM st WHERE running ORDER BY ts DESC, machine, pk, sk LIMIT 1",
)
def foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stages, _ = progress_tables(spark, sf_dir)
    return stages.filter("foreground").select("project_key", "stage_key")


_PERCENT = "CASE WHEN {nt} > 0 THEN printf('%.0f%%', round_even({nd} * 100.0::DOUBLE / {nt}, 1)) ELSE 'n/a' END"


@query(
    "summary_lines",
    f"""WITH {_PROG} SELECT any_value(project) || ': ' || {_PERCENT.format(nt="sum(nt)", nd="sum(nd)")} || ' of ' || count(*) || ' stages, ' || count(*) FILTER (running) || ' running' AS line
      FROM st GROUP BY machine, pk
      UNION ALL SELECT '  - ' || title || ': ' || {_PERCENT.format(nt="nt", nd="nd")} || ', ' || nd || ' of ' || nt || ' to-dos' || CASE WHEN running THEN ', running' ELSE '' END
        || CASE WHEN sk = (SELECT sk FROM st WHERE running ORDER BY ts DESC, machine, pk, sk LIMIT 1) THEN ', in front' ELSE '' END FROM st""",
)
def summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects, stages, _ = progress_tables(spark, sf_dir)
    return P.summary_lines(projects, stages)


_EDITS = """edits AS (SELECT CASE k % 3 WHEN 0 THEN 'project' WHEN 1 THEN 'stage' ELSE 'other' END AS level, CAST(user_id AS VARCHAR) AS key,
    CASE WHEN k % 2 = 0 THEN 'title' ELSE 'hidden' END AS field, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 5 = 0 THEN '' ELSE 't' || k END ELSE CASE WHEN k % 4 = 1 THEN 'true' ELSE 'false' END END AS value, ts FROM facts),
last_edit AS (SELECT level, key, field, arg_max(value, ts) AS value FROM edits WHERE level <> 'other' AND (field = 'hidden' OR value <> '') GROUP BY level, key, field),
cur AS (SELECT level, key, max(value) FILTER (field = 'title') AS new_title, max(value) FILTER (field = 'hidden') = 'true' AS new_hidden FROM last_edit GROUP BY level, key)"""


def _overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    e = event_facts(load(spark, sf_dir, "events"))
    title = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("t"), k.cast("string")))
    log = e.select(
        F.when(k % 3 == 0, "project").when(k % 3 == 1, "stage").otherwise("other").alias("level"), F.col("user_id").cast("string").alias("key"),
        F.when(k % 2 == 0, "title").otherwise("hidden").alias("field"),
        F.when(k % 2 == 0, title).otherwise(F.when(k % 4 == 1, "true").otherwise("false")).alias("value"), F.col("ts").alias("at"),
    )
    return P.current_overlay(log)


@query("overlay_latest", f"WITH {O.FACTS}, {_EDITS} SELECT * FROM cur")
def overlay_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlay(spark, sf_dir).select("level", "key", "new_title", "new_hidden")


@query(
    "apply_overlay",
    f"""WITH {O.FACTS}, {_EDITS}, {_PROG} SELECT sk AS stage_key, coalesce(new_title, title) AS title, coalesce(new_hidden, hidden) AS hidden
      FROM st LEFT JOIN cur ON cur.level = 'stage' AND cur.key = CAST(sk AS VARCHAR)""",
)
def apply_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, stages, _ = progress_tables(spark, sf_dir)
    named = stages.withColumn("stage_key", F.col("stage_key").cast("string"))
    out = P.apply_overlay(named, _overlay(spark, sf_dir), "stage")
    return out.select(F.col("stage_key").cast("bigint").alias("stage_key"), "title", "hidden")


# --- merging: machine = user_id % 3; machine m1 carries another schema version


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = silver.prepared(spark, sf_dir)
    return p.groupBy("machine").agg(
        F.max("latest_ts").alias("generated_utc"), F.count("j.score").alias("judged"), F.count("*").alias("lifetime_sessions")
    ).withColumns(
        {
            "schema_version": F.when(F.col("machine") == "m1", "2.1").otherwise("1.4"), "reader_version": F.lit("2.0.0"),
            "judge_tokens": F.col("judged") * 10, "excerpts_published": F.lit(False), "window_days": F.lit(365),
        }
    )


def _merged(spark: SparkSession, sf_dir: str) -> merge.Merged:
    p = silver.prepared(spark, sf_dir)
    life = S.sum_counters(S.explode_models(p, ["machine"]), ["machine", "model"])
    return merge.merge_feeds(p, life, _meta(spark, sf_dir))


@query("schema_gate", f"WITH {O.PREPARED} SELECT DISTINCT machine, '2.1' AS schema_version, '2.0.0' AS reader_version FROM prep WHERE machine = 'm1'")
def schema_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).skipped


@query(
    "merge_feeds",
    f"""WITH {O.PREPARED} SELECT count(DISTINCT machine) AS machines, count(score) AS judged, CAST(count(score) * 10 AS BIGINT) AS judge_tokens,
      count(*) AS lifetime_sessions FROM prep WHERE machine <> 'm1'""",
)
def merge_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).totals.select("machines", "judged", "judge_tokens", "lifetime_sessions")


@query(
    "merge_feeds_lifetime",
    f"""WITH {O.FACTS}, {O.CALLS} SELECT model, count(*) AS calls, CAST(sum(cr) AS BIGINT) AS cr, CAST(sum(tout) AS BIGINT) AS "out"
      FROM calls WHERE (session // 3) % 3 <> 1 GROUP BY model""",
)
def merge_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).lifetime.select("model", "calls", "cr", "out")


@query("merge_feeds_sessions", f"WITH {O.PREPARED} SELECT session, machine FROM prep WHERE machine <> 'm1'")
def merge_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).sessions.select(silver.session_number().alias("session"), "machine")


@query(
    "newest_note",
    f"""WITH {O.FACTS} SELECT 'm' || CAST(user_id % 3 AS VARCHAR) AS machine, strftime(ts, '%Y-%m-%d') AS date, CAST(k AS BIGINT) AS judged_total
      FROM facts WHERE event_type = 'purchase' AND strftime(ts, '%Y-%m-%d') = (SELECT max(strftime(ts, '%Y-%m-%d')) FROM facts WHERE event_type = 'purchase')
      ORDER BY 1, k LIMIT 1""",
)
def newest_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_facts(load(spark, sf_dir, "events")).filter("event_type = 'purchase'")
    notes = e.select(
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("machine"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.col("k").cast("bigint").alias("judged_total"),
    ).groupBy("machine", "date").agg(F.min("judged_total").alias("judged_total"))
    return merge.newest_note(notes)


# --- review -------------------------------------------------------------------

_NOW = "2024-01-31 00:00:00"


def _prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier reviews: labelled ids, with attempts and result by quality."""
    labels = load(spark, sf_dir, "labels")
    return labels.select(
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("sid"), (F.col("doc_id") % 4).alias("attempts"), F.lit(4).cast("bigint").alias("n_turns"),
        F.lit("2024-01-20 00:00:00").cast("timestamp").alias("at"), (F.col("quality") == 1).alias("has_result"),
    )


_QUEUE = f"""{O.PREPARED}, l AS (SELECT session, max(ts) AS latest FROM facts GROUP BY session),
q AS (SELECT prep.session, latest, human_turns FROM prep JOIN l USING (session) LEFT JOIN labels lb ON lb.doc_id = prep.session
  WHERE human_turns >= 2
    AND ((session % 3 = 0 AND (session // 3) % 3 <> 0) OR (session % 5 <> 0 AND latest < TIMESTAMP '{_NOW}' - INTERVAL 6 HOUR))
    AND NOT coalesce(lb.quality <> 1 AND session % 4 >= 2, false) AND NOT coalesce(lb.quality = 1 AND human_turns - 4 < 3, false))"""


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = silver.prepared(spark, sf_dir)
    return p.filter(silver.session_number() % 5 == 0).select("sid")


@query("eligible_for_review", f"WITH {_QUEUE} SELECT session, human_turns FROM q")
def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(_NOW).cast("timestamp")
    out = review.eligible_for_review(silver.prepared(spark, sf_dir), _prior(spark, sf_dir), _live(spark, sf_dir), now, attempts=fixed.MAX_ATTEMPTS)
    return out.select(silver.session_number().alias("session"), "human_turns")


@query("review_queue", f"WITH {_QUEUE} SELECT session, human_turns FROM q ORDER BY latest DESC, session DESC LIMIT 3")
def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(_NOW).cast("timestamp")
    out = review.review_queue(silver.prepared(spark, sf_dir), _prior(spark, sf_dir), _live(spark, sf_dir), now, limit=3, attempts=fixed.MAX_ATTEMPTS)
    return out.select(silver.session_number().alias("session"), "human_turns")


def _verdicts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labels as verdicts with known faults, and some that nobody queued; every problem by name."""
    d, labels = F.col("doc_id"), load(spark, sf_dir, "labels")
    sid = F.concat(F.lit("s"), d.cast("string"))
    turn = F.struct(
        F.when(d % 23 == 0, 0).otherwise(1).cast("bigint").alias("i"), F.when(d % 11 == 0, "nonsense").otherwise("approval").alias("label"),
        F.when(d % 19 == 0, "bad luck").alias("cause"),
    )
    yes = [F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))]
    answers = [*yes, F.lit(False), F.when(d % 29 != 0, F.lit(False)), F.lit(False)]
    rubric = F.struct(*[c.alias(k) for c, k in zip(answers, fixed.RUBRIC)])
    verdicts = labels.select(
        d, sid.alias("file_sid"), F.when(d % 31 == 0, "other").otherwise(sid).alias("sid"), F.lit(3).cast("bigint").alias("n_turns"),
        F.when(d % 41 != 0, F.array(turn)).alias("turns"), rubric.alias("first_prompt"),
        (d % 3).alias("score"), F.array(F.when(d % 13 == 0, "the moon").otherwise("priority")).alias("missing"),
        F.when(d % 17 == 0, "unheard of").otherwise("completed").alias("outcome"),
        F.when(d % 37 == 0, F.repeat(F.lit("x"), 141)).when(d % 5 == 0, "please keep the old parser exactly as it was").otherwise("A short neutral summary.").alias("summary"),
    )
    queue = labels.filter(d % 43 != 0).select(
        sid.alias("sid"), F.when(d % 7 == 0, 9).otherwise(3).cast("bigint").alias("n_turns"),
        F.array(F.struct(F.lit("Please keep the old parser exactly as it was today").alias("you"))).alias("turns"),
    )
    return review.match_queue(verdicts, queue)


@query(
    "verdict_validation",
    """SELECT doc_id, concat_ws(' / ',
      CASE WHEN doc_id % 7 = 0 THEN 'length: other turn count than queued' END, CASE WHEN doc_id % 13 = 0 THEN 'missing: item outside the vocabulary' END,
      CASE WHEN doc_id % 17 = 0 THEN 'outcome: outside the vocabulary' END,
      CASE WHEN doc_id % 29 = 0 THEN 'rubric: unanswered item among goal/context/constraints/done_criterion/scope'
        WHEN quality + toxic <> doc_id % 3 THEN 'score: differs from the rubric''s yes answers' END,
      CASE WHEN doc_id % 31 = 0 THEN 'session: another id than the file''s' END,
      CASE WHEN doc_id % 37 = 0 THEN 'summary: absent or over 140 characters' WHEN doc_id % 5 = 0 THEN 'summary: repeats a turn word for word' END,
      CASE WHEN doc_id % 41 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'turn.label: nonsense' WHEN doc_id % 19 = 0 THEN 'turn.cause: bad luck' WHEN doc_id % 23 = 0 THEN 'turn.number: counted from one' END,
      CASE WHEN doc_id % 41 = 0 THEN 'turns: none given' END) AS problems FROM labels WHERE doc_id % 43 <> 0
      UNION ALL SELECT doc_id, 'stray: nobody queued this session' FROM labels WHERE doc_id % 43 = 0""",
)
def verdict_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every problem by name, those of verdicts that nobody queued too."""
    matched, stray = _verdicts(spark, sf_dir)
    checked = review.validate_verdicts(matched).select("doc_id", "problems").unionByName(stray.select("doc_id", "problems"))
    return checked.select("doc_id", F.array_join("problems", " / ").alias("problems"))


_GOOD = """doc_id % 43 <> 0 AND doc_id % 7 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 29 <> 0 AND quality + toxic = doc_id % 3 AND doc_id % 31 <> 0
  AND doc_id % 37 <> 0 AND doc_id % 5 <> 0 AND doc_id % 41 <> 0 AND doc_id % 11 <> 0 AND doc_id % 19 <> 0 AND doc_id % 23 <> 0"""


@query(
    "verdict_ingest",
    f"""SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END + CASE WHEN doc_id % 43 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS attempts,
        CASE WHEN {_GOOD} THEN 'reviewer' WHEN doc_id % 4 = 0 THEN 'before' END AS judged_by,
        CAST(CASE WHEN {_GOOD} THEN doc_id % 3 WHEN doc_id % 4 = 0 THEN 9 ELSE -1 END AS BIGINT) AS score,
        CAST(CASE WHEN doc_id % 43 <> 0 THEN CASE WHEN doc_id % 7 = 0 THEN 9 ELSE 3 END ELSE 2 END AS BIGINT) AS n_turns
      FROM labels WHERE doc_id % 43 <> 0 OR doc_id % 4 = 0""",
)
def verdict_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch into a store that has some of its sessions: attempts count, a rejected verdict leaves the earlier result."""
    matched, _ = _verdicts(spark, sf_dir)
    earlier = load(spark, sf_dir, "labels").filter(F.col("doc_id") % 4 == 0)
    result = F.when(F.lit(True), F.struct(F.lit(9).cast("bigint").alias("score")))
    store = earlier.select(
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("sid"), F.lit(2).cast("bigint").alias("n_turns"), F.lit(_NOW).cast("timestamp").alias("at"),
        F.lit(2).cast("bigint").alias("attempts"), F.lit("before").alias("judged_by"), result.alias("result"),
    )
    empty = review.empty_store(spark)
    wide = store.withColumn("result", F.from_json(F.to_json("result"), empty.schema["result"].dataType))
    out = review.ingest(empty.unionByName(wide), review.validate_verdicts(matched).withColumn("judged_by", F.lit(None).cast("string")), F.lit(_NOW).cast("timestamp"))
    return out.select(F.substring("sid", 2, 20).cast("bigint").alias("doc_id"), "attempts", "judged_by", F.coalesce(F.col("result.score"), F.lit(-1)).alias("score"), "n_turns")


@query(
    "review_status",
    f"""WITH {O.PREPARED}, l AS (SELECT session, max(ts) AS latest FROM facts GROUP BY session),
      m AS (SELECT coalesce(arg_max(doc_id * 3, CAST(doc_id AS VARCHAR)), 0) AS mark FROM labels), j AS (SELECT count(*) FILTER (quality = 1) AS judged FROM labels)
      SELECT judged, (SELECT count(*) FROM prep JOIN l USING (session) WHERE human_turns >= 2 AND ((session % 3 = 0 AND (session // 3) % 3 <> 0) OR (session % 5 <> 0 AND latest < TIMESTAMP '{_NOW}' - INTERVAL 6 HOUR))) AS eligible,
        (SELECT count(*) FROM labels WHERE toxic = 1) AS awaiting, (SELECT count(*) FROM labels WHERE doc_id % 7 = 0) AS rejected, CAST(judged - mark AS BIGINT) AS since_note, judged - mark >= {fixed.NOTE_EVERY} AS note_due
      FROM j, m""",
)
def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = load(spark, sf_dir, "labels")
    store = labels.select(F.when(F.col("quality") == 1, "yes").alias("result"))
    notes = labels.select(F.col("doc_id").cast("string").alias("date"), (F.col("doc_id") * 3).alias("judged_total"))
    return review.review_status(silver.prepared(spark, sf_dir), store, _live(spark, sf_dir), labels.filter("toxic = 1"), labels.filter("doc_id % 7 = 0"), notes, F.lit(_NOW).cast("timestamp"))


_FLAGS = {"is_steer": fixed.FLAG_STEERING, "is_bound0": fixed.FLAG_COMPACTION, "is_du": fixed.FLAG_REJECTED, "is_dp": fixed.FLAG_PERMISSION, "is_int": fixed.FLAG_INTERRUPT}
_FLAG_SQL = "CASE " + " ".join(f"WHEN {c} THEN '{flag}'" for c, flag in _FLAGS.items()) + " END"


@query(
    "session_digests",
    f"""WITH {O.TURNS}, a AS (SELECT session, turn_no, CASE k % 5 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Edit' WHEN 2 THEN 'AskUserQuestion' WHEN 3 THEN 'Read' ELSE 'Skill' END AS tool, event_id FROM t2 WHERE is_tool),
      g AS (SELECT session, turn_no, tool, count(*) AS n, min(event_id) AS first FROM a GROUP BY ALL),
      u AS (SELECT session, turn_no, string_agg(tool || ':' || n, ',' ORDER BY n DESC, first) AS tools FROM g GROUP BY ALL),
      f AS (SELECT session, turn_no, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags FROM (SELECT session, turn_no, {_FLAG_SQL} AS flag FROM t2 WHERE NOT is_human) WHERE flag IS NOT NULL GROUP BY ALL)
      SELECT h.session, h.turn_no AS i, coalesce(tools, '') AS tools, coalesce(flags, '') AS flags FROM t2 h LEFT JOIN u USING (session, turn_no) LEFT JOIN f USING (session, turn_no) WHERE is_human""",
)
def session_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened after each turn and before the next: tools by use, and flags."""
    turns = review.build_digests(silver.records(spark, sf_dir)).select(silver.session_number().alias("session"), F.explode("turns").alias("t"))
    tools = F.array_join(F.transform("t.tools", lambda x: F.concat(x["tool"], F.lit(":"), x["n"].cast("string"))), ",")
    return turns.select("session", F.col("t.i").alias("i"), tools.alias("tools"), F.array_join("t.flags", ",").alias("flags"))


@query(
    "actions_between_turns",
    f"""WITH {O.TURNS}, a AS (SELECT session, turn_no, CASE k % 5 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Edit' WHEN 2 THEN 'AskUserQuestion' WHEN 3 THEN 'Read' ELSE 'Skill' END AS tool, event_id FROM t2 WHERE is_tool AND turn_no > 0),
      g AS (SELECT session, turn_no, tool, count(*) AS n, min(event_id) AS first FROM a GROUP BY ALL)
      SELECT session, turn_no, tool, n, CAST(row_number() OVER (PARTITION BY session, turn_no ORDER BY n DESC, first) AS INTEGER) AS rank FROM g""",
)
def actions_between_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = silver.state(spark, sf_dir).select("path", "line_no", "turn_no")
    uses = S.tool_events(silver.records(spark, sf_dir)).filter("is_use").join(placed, ["path", "line_no"])
    events = uses.select(silver.session_number().alias("session"), "turn_no", "tool", F.struct("line_no", "pos").alias("position"))
    return ordered.actions_between_turns(events, ["session"], "turn_no", "tool")


# --- other tables -------------------------------------------------------------


@query(
    "dedupe_first_wins",
    """SELECT l_orderkey, arg_min(l_partkey, l_linenumber * 1000000000::BIGINT + l_partkey) AS l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey""",
)
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.lit(0).alias("all"))
    twice = items.unionByName(items)
    place = F.col("l_linenumber") * F.lit(1_000_000_000).cast("bigint") + F.col("l_partkey")
    return ordered.dedupe_first(twice, ["all"], "l_orderkey", place).drop("all")


@query(
    "pooled_rate_orders",
    """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS events, count(*)::DOUBLE AS turns,
      round(count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*) * 10, 6) AS rate FROM orders GROUP BY o_orderpriority""",
)
def pooled_rate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    hit = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
    out = cohorts.pooled_rate(orders, ["o_orderpriority"], hit, F.lit(1.0))
    return out.select("o_orderpriority", "n", "events", "turns", F.round("rate", 6).alias("rate"))


@query(
    "median_orders",
    "SELECT o_orderpriority, round(median(o_totalprice), 4) AS median_price FROM orders GROUP BY o_orderpriority",
)
def median_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = medians(load(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", "median_price")
    return out.select("o_orderpriority", F.round("median_price", 4).alias("median_price"))


@query(
    "burst_sessions",
    f"""WITH {O.FACTS}, g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id)) <= 21600000000 THEN 0 ELSE 1 END AS new FROM facts),
    b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM b GROUP BY user_id, burst""",
)
def burst_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_facts(load(spark, sf_dir, "events")).select("user_id", "event_id", "ts")
    out = ordered.activity_bursts(e, by_number(("user_id",), "event_id"), "ts", 6 * 3600)
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(
    "relative_age",
    """WITH a AS (SELECT event_id, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 1000000.0::DOUBLE AS s FROM events)
    SELECT event_id, CASE WHEN s < 8 THEN 'just now' WHEN s < 60 THEN CAST(floor(s) AS BIGINT) || 's ago' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago'
      WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago' WHEN s < 604800 THEN CAST(floor(s / 86400) AS BIGINT) || 'd ago' ELSE CAST(floor(s / 604800) AS BIGINT) || 'w ago' END AS age FROM a""",
)
def relative_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.select("event_id", formats.relative_age(F.col("ts").cast("timestamp"), F.lit(_NOW).cast("timestamp")).alias("age"))
