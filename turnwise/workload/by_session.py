"""Queries over ``events`` seen as session transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise import fixed
from turnwise.operators import cohorts, ordered, pricing, rules, sessions as S
from turnwise.operators.ordering import LINES
from turnwise.workload import oracle as O, silver
from turnwise.workload.silver import session_number

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _e5(col: str) -> F.Column:
    """Money in hundred-thousandths, rounded away from any exact tie."""
    return F.floor(F.col(col) * 100000 + 0.31372).alias("usd_e5")


_E5_SQL = "CAST(floor({} * 100000 + 0.31372) AS BIGINT) AS usd_e5"


def _long(*cols: str) -> list:
    return [F.col(c).cast("bigint").alias(c) for c in cols]


def _six(*cols: str) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


# --- records and ordered signals ----------------------------------------------


@query(
    "record_kinds",
    f"""WITH {O.FACTS}, lines AS (
      SELECT session, CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'assistant' WHEN 'error' THEN 'user'
               WHEN 'signup' THEN CASE WHEN k < 25 THEN 'system' ELSE 'attachment' END ELSE 'assistant' END AS rtype,
             event_type = 'view' AS h FROM facts
      UNION ALL SELECT session, 'user', false FROM facts WHERE event_type = 'purchase')
    SELECT session, rtype, count(*) AS n, count(*) FILTER (h) AS human FROM lines GROUP BY session, rtype""",
)
def record_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = silver.records(spark, sf_dir)
    return rec.groupBy(session_number().alias("session"), "rtype").agg(
        F.count("*").alias("n"), F.count_if("is_human").alias("human")
    )


@query(
    "turn_numbers",
    f"WITH {O.TURNS} SELECT event_id, session, turn_no FROM t2 WHERE is_human",
)
def turn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = silver.records(spark, sf_dir).select("path", "line_no", "is_human")
    placed = ordered.turn_numbers(rec, LINES, F.col("is_human"))
    return placed.filter("is_human").select(
        F.floor(F.col("line_no") / 2).alias("event_id"), session_number().alias("session"), "turn_no"
    )


@query(
    "minutes_in",
    f"""WITH {O.FACTS}, m AS (SELECT session, event_id, event_type,
          epoch_us(max(ts) OVER w) - epoch_us(min(ts) OVER w) AS us FROM facts
        WINDOW w AS (PARTITION BY session ORDER BY event_id))
    SELECT session, event_id, CAST(round(round_even(us / 60000000.0::DOUBLE, 2) * 100) AS BIGINT) AS hundredths FROM m WHERE event_type = 'view'""",
)
def minutes_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = silver.records(spark, sf_dir).select("path", "line_no", "ts", "is_human")
    seen = ordered.minutes_in(rec, LINES, "ts")
    return seen.filter("is_human").select(
        session_number().alias("session"), F.floor(F.col("line_no") / 2).alias("event_id"), _hundredths(F.col("minutes_in")).alias("hundredths")
    )


def _hundredths(minutes: F.Column) -> F.Column:
    return F.round(minutes * 100).cast("bigint")


@query(
    "active_seconds",
    f"""WITH {O.TURNS} SELECT session,
      round(CAST(coalesce(sum(gap) FILTER (gap > 0 AND gap <= 21600000000), 0) AS DOUBLE) / 1000000, 3) AS active_seconds,
      count(*) FILTER (gap > 0 AND gap <= 21600000000) AS gaps FROM t2 GROUP BY session""",
)
def active_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = silver.records(spark, sf_dir)
    out = ordered.active_seconds(rec, LINES, "ts", max_gap=6 * 3600)
    return out.select(session_number().alias("session"), F.round("active_seconds", 3).alias("active_seconds"), "gaps")


@query(
    "first_event_turn",
    f"""WITH {O.SESSIONS} SELECT session, first_ask_turn, first_edit_turn, first_correction_turn FROM sig""",
)
def first_event_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = silver.state(spark, sf_dir)
    marks = ordered.first_mark_turn(st, ["path"], F.col("mark_turn"), F.col("mark_turn").isNotNull(), "first_correction_turn")
    asks = ordered.first_mark_turn(st, ["path"], F.col("turn_no"), F.col("n_ask") > 0, "first_ask_turn")
    edits = ordered.first_mark_turn(st, ["path"], F.col("turn_no"), F.col("n_edit") > 0, "first_edit_turn")
    return asks.join(edits, "path").join(marks, "path").select(
        session_number().alias("session"), *_long("first_ask_turn", "first_edit_turn", "first_correction_turn")
    )


@query(
    "post_boundary_window",
    f"""WITH {O.TURNS} SELECT session, event_id, since AS turns_since,
      coalesce(is_human AND since BETWEEN 1 AND 5, false) AS turn_in_window,
      coalesce(is_int AND since < 5, false) AS interrupt_in_window FROM t2 WHERE is_human OR is_int""",
)
def post_boundary_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = silver.state(spark, sf_dir).filter("is_human or interrupt is not null")
    return st.select(
        session_number().alias("session"), F.floor(F.col("line_no") / 2).alias("event_id"), "turns_since",
        (F.col("is_human") & F.col("turn_in_window")).alias("turn_in_window"),
        (F.col("interrupt").isNotNull() & F.col("interrupt_in_window")).alias("interrupt_in_window"),
    )


@query(
    "drop_repeated_boundaries",
    f"WITH {O.TURNS} SELECT session, event_id FROM kept",
)
def drop_repeated_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = silver.records(spark, sf_dir).filter("is_boundary").select("path", "line_no", "compact.pre", "compact.dropped")
    kept = ordered.drop_repeated_boundaries(b, LINES, ["pre", "dropped"])
    return kept.select(session_number().alias("session"), F.floor(F.col("line_no") / 2).alias("event_id"))


@query(
    "dedupe_calls",
    f"WITH {O.FACTS}, {O.CALLS} SELECT session, event_id, model, c AS ctx FROM ctx",
)
def dedupe_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = silver.calls(spark, sf_dir).filter("msg_id is not null")
    return calls.select(session_number().alias("session"), F.floor(F.col("line_no") / 2).alias("event_id"), "model", "ctx")


@query(
    "counter_resets",
    f"""WITH {O.FACTS}, {O.CALLS}
    SELECT session, count(*) AS calls, count(*) FILTER (prev_cr <> 0 AND cr < prev_cr * 0.5) AS resets FROM ctx GROUP BY session""",
)
def counter_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = silver.calls(spark, sf_dir).filter("ctx > 0").select("path", "line_no", F.col("usage.cr").alias("cr"))
    seen = ordered.counter_resets(calls, LINES, "cr")
    return seen.groupBy(session_number().alias("session")).agg(F.count("*").alias("calls"), F.count_if("is_reset").alias("resets"))


@query(
    "peak_and_final",
    f"WITH {O.SESSIONS} SELECT session, ctx_peak AS peak, ctx_final AS final, peak_model AS peak_label FROM ctx_stats",
)
def peak_and_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = silver.calls(spark, sf_dir).filter("ctx > 0")
    out = ordered.peak_and_final(calls, LINES, "ctx", "model")
    return out.select(session_number().alias("session"), "peak", "final", "peak_label")


@query(
    "series_downsample",
    f"""WITH {O.FACTS}, p AS (SELECT user_id, event_id, CAST(trunc(value * 100) AS BIGINT) AS y,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i,
         count(*) OVER (PARTITION BY user_id) AS n, max(CAST(trunc(value * 100) AS BIGINT)) OVER (PARTITION BY user_id) AS top FROM facts),
    s AS (SELECT *, CASE WHEN n <= 32 THEN i ELSE CAST(round(i / (CAST(n - 1 AS DOUBLE) / 31)) AS BIGINT) END AS slot FROM p),
    kept AS (SELECT * FROM s WHERE n <= 32 OR CAST(round_even(slot * (CAST(n - 1 AS DOUBLE) / 31), 0) AS BIGINT) = i),
    peak AS (SELECT user_id, min(event_id) AS event_id, any_value(top) AS y FROM s WHERE y = top GROUP BY user_id),
    has AS (SELECT DISTINCT kept.user_id FROM kept JOIN peak USING (user_id, event_id)),
    pts AS (SELECT kept.user_id, CASE WHEN has.user_id IS NULL AND kept.slot = 16 THEN peak.event_id ELSE kept.event_id END AS event_id,
                   CASE WHEN has.user_id IS NULL AND kept.slot = 16 THEN peak.y ELSE kept.y END AS y
            FROM kept JOIN peak USING (user_id) LEFT JOIN has USING (user_id))
    SELECT user_id, CAST(event_id AS DOUBLE) AS x, y FROM pts""",
)
def series_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.operators.ordering import by_number
    from turnwise.workload.adapter import event_facts, load

    e = event_facts(load(spark, sf_dir, "events")).select(
        "user_id", "event_id", F.col("event_id").cast("double").alias("x"), (F.col("value") * 100).cast("bigint").alias("y")
    )
    series = ordered.downsample_series(e, by_number(("user_id",), "event_id"), "x", "y", fixed.SERIES_POINTS)
    return series.select("user_id", F.explode("series").alias("p")).select("user_id", F.col("p.min").alias("x"), F.col("p.ctx").alias("y"))


@query(
    "tool_result_match",
    f"""WITH {O.FACTS}, ev AS (SELECT user_id, event_id, event_type,
          lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before,
          lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before_id
        FROM facts WHERE event_type IN ('click', 'purchase'))
    SELECT user_id, event_id, CASE WHEN before = 'click' THEN before_id END AS use_id FROM ev WHERE event_type = 'purchase'""",
)
def tool_result_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.operators.ordering import by_number
    from turnwise.workload.adapter import event_facts, load

    e = event_facts(load(spark, sf_dir, "events")).filter("event_type in ('click', 'purchase')").select(
        F.lit(0).alias("all"), "user_id", "event_id", (F.col("event_type") == "click").alias("is_use"), F.col("event_id").alias("use_id")
    )
    out = ordered.match_results(e, by_number(("all",), "event_id"), "user_id", F.col("is_use"), ["use_id"])
    return out.select("user_id", "event_id", "use_id")


@query(
    "latest_meta",
    f"""WITH {O.FACTS} SELECT session, arg_max(k, event_id) FILTER (event_type = 'view') AS last_k,
       arg_min(k, event_id) FILTER (event_type = 'click') AS first_click_k,
       epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS latest_us FROM facts GROUP BY session""",
)
def latest_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.operators.ordering import by_number
    from turnwise.workload.adapter import event_facts, load

    e = event_facts(load(spark, sf_dir, "events")).withColumns(
        {
            "last_k": F.when(F.col("event_type") == "view", F.col("k")),
            "first_click_k": F.when(F.col("event_type") == "click", F.col("k")),
        }
    )
    out = ordered.latest_meta(e, by_number(("session",), "event_id"), last=["last_k"], first=["first_click_k"], ts="ts")
    return out.select(
        "session", "last_k", "first_click_k", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("latest_ts").alias("latest_us")
    )


@query(
    "turn_minutes",
    f"""WITH {O.FACTS}, m AS (SELECT session, event_id, event_type, epoch_us(max(ts) OVER w) - epoch_us(min(ts) OVER w) AS us FROM facts
        WINDOW w AS (PARTITION BY session ORDER BY event_id))
      SELECT session, count(*) AS listed, string_agg(CAST(CAST(round(round_even(us / 60000000.0::DOUBLE, 2) * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY event_id) AS hundredths
      FROM m WHERE event_type = 'view' GROUP BY session""",
)
def turn_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = silver.state(spark, sf_dir).filter("is_human")
    out = ordered.turn_minutes(st, ["path"], "turn_no", "minutes_in")
    listed = F.array_join(F.transform("turn_min", lambda m: _hundredths(m).cast("string")), ",")
    return out.select(session_number().alias("session"), F.size("turn_min").cast("bigint").alias("listed"), listed.alias("hundredths"))


@query(
    "repeated_wording_sessions",
    f"WITH {O.TURNS} SELECT session, event_id, is_rep AS repeated FROM t2 WHERE is_human",
)
def repeated_wording_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = silver.records(spark, sf_dir).filter("is_human").select("path", "line_no", "text")
    out = ordered.repeated_wording(turns, ["path"], "line_no", "text")
    return out.select(session_number().alias("session"), F.floor(F.col("line_no") / 2).alias("event_id"), "repeated")


# --- aggregates ---------------------------------------------------------------

_COUNTS = (
    "human_turns", "askuser", "tool_calls_total", "first_ask_turn", "first_edit_turn", "interrupts", "interrupts_tool",
    "denied_user", "denied_plan", "steering", "lex_corrections", "reexplain", "reexplain_after_compaction",
    "turns_after_compaction", "interrupts_after_compaction", "first_correction_turn", "cache_resets", "ctx_peak",
    "ctx_final", "ctx_window", "tests_run", "git_commits",
)


@query(
    "session_rollup",
    f"""WITH {O.SESSIONS} SELECT session, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _COUNTS)}, tokens, n_compactions, n_auto,
      peak_model, plan_mode, has_path, has_constraint, has_done_criterion FROM sess""",
)
def session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = silver.sessions(spark, sf_dir)
    return s.select(
        session_number().alias("session"), *_long(*_COUNTS), S.tokens_of(F.col("by_model")).alias("tokens"),
        F.size("compactions").cast("bigint").alias("n_compactions"),
        F.size(F.filter("compactions", lambda c: c["trigger"] == "auto")).cast("bigint").alias("n_auto"),
        "peak_model", "plan_mode", "has_path", "has_constraint", "has_done_criterion",
    )


@query(
    "signal_counts",
    f"""WITH {O.SESSIONS} SELECT machine, CAST(sum(interrupts) AS BIGINT) AS interrupts, CAST(sum(denied_user) AS BIGINT) AS denied_user,
      CAST(sum(denied_plan) AS BIGINT) AS denied_plan, CAST(sum(steering) AS BIGINT) AS steering,
      CAST(sum(lex_corrections) AS BIGINT) AS lex_corrections
      FROM (SELECT *, (session // 3) % 3 AS machine FROM sig) GROUP BY machine""",
)
def signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = S.signal_counts(silver.state(spark, sf_dir))
    names = ("interrupts", "denied_user", "denied_plan", "steering", "lex_corrections")
    return sig.groupBy((F.floor(session_number() / 3) % 3).alias("machine")).agg(*[F.sum(c).alias(c) for c in names])


@query(
    "usage_by_model",
    f"""WITH {O.FACTS}, {O.CALLS} SELECT session, model, count(*) AS calls, CAST(sum(tin) AS BIGINT) AS "in",
      CAST(sum(cc5) AS BIGINT) AS cc5, CAST(sum(cc1h) AS BIGINT) AS cc1h, CAST(sum(cr) AS BIGINT) AS cr,
      CAST(sum(tout) AS BIGINT) AS "out", CAST(sum(think) AS BIGINT) AS think, count(*) FILTER (fast) AS fast_calls
      FROM calls GROUP BY session, model""",
)
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.usage_by_model(silver.calls(spark, sf_dir)).withColumn("session", session_number()).drop("path")


@query(
    "tool_usage",
    f"""WITH {O.FACTS}, {O.TOOLS} SELECT session, tool, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(errors) AS BIGINT) AS errors,
      CAST(sum(size) AS BIGINT) AS result_chars, CAST(sum(results) AS BIGINT) AS results FROM tool_rows GROUP BY session, tool""",
)
def tool_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = S.tool_events(silver.records(spark, sf_dir))
    usage = S.tool_usage(ev, S.tool_results(ev))
    return usage.select(session_number().alias("session"), "tool", "calls", "errors", "result_chars", "results")


@query(
    "outcome_counts",
    f"""WITH {O.SESSIONS} SELECT session, coalesce(tests_run, 0) AS tests_run, coalesce(git_commits, 0) AS git_commits FROM sess
        WHERE tool_calls_total + denied_user + denied_plan > 0""",
)
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = S.tool_events(silver.records(spark, sf_dir))
    return S.outcome_counts(S.tool_results(ev)).withColumn("session", session_number()).drop("path")


@query(
    "session_sets",
    f"""WITH {O.FACTS}, {O.TOOLS}, eff AS (SELECT session, count(*) FILTER (k % 3 = 0) AS high, count(*) FILTER (k % 3 <> 0) AS low
        FROM facts WHERE event_type = 'click' GROUP BY session),
      sk AS (SELECT session, string_agg(skill, ',' ORDER BY first_at) AS skills FROM
        (SELECT session, 'skill' || CAST(k % 4 AS VARCHAR) AS skill, min(event_id) AS first_at FROM tool_calls WHERE tool = 'Skill' GROUP BY ALL)
        GROUP BY session)
      SELECT session, high, low, skills FROM eff FULL JOIN sk USING (session)""",
)
def session_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = silver.records(spark, sf_dir)
    efforts = S.effort_map(silver.state(spark, sf_dir)).select(
        "path", F.coalesce(F.try_element_at("effort", F.lit("high")), F.when(F.col("effort").isNotNull(), 0)).alias("high"),
        F.coalesce(F.try_element_at("effort", F.lit("low")), F.when(F.col("effort").isNotNull(), 0)).alias("low"),
    )
    skills = S.sighted_sets(rec, S.tool_events(rec)).select("path", F.array_join("skills", ",").alias("skills"))
    return efforts.join(skills, "path", "full").select(session_number().alias("session"), "high", "low", "skills")


@query(
    "lifetime_totals",
    f"""WITH {O.FACTS}, {O.CALLS} SELECT model, count(*) AS calls, CAST(sum(tin) AS BIGINT) AS "in",
      CAST(sum(cc5) AS BIGINT) AS cc5, CAST(sum(cc1h) AS BIGINT) AS cc1h, CAST(sum(cr) AS BIGINT) AS cr,
      CAST(sum(tout) AS BIGINT) AS "out", CAST(sum(think) AS BIGINT) AS think, count(*) FILTER (fast) AS fast_calls
      FROM calls GROUP BY model""",
)
def lifetime_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lifetime_totals(silver.sessions(spark, sf_dir))


@query(
    "resume_link",
    f"WITH {O.PREPARED} SELECT session, session - 1 AS resumed_from FROM prep WHERE is_resumed",
)
def resume_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = silver.prepared(spark, sf_dir).filter("is_resumed")
    return linked.select(session_number().alias("session"), F.substring("resumed_from", 2, 20).cast("bigint").alias("resumed_from"))


# --- statistics and rules -----------------------------------------------------

ANCHORS_SQL = f"""WITH {O.PREPARED} SELECT anchors, count(*) AS n, CAST(sum(hard) AS BIGINT) AS events, CAST(sum(human_turns) AS BIGINT) AS turns,
      round(CAST(sum(hard) AS DOUBLE) / sum(human_turns) * 10, 6) AS rate,
      round(greatest(0, CAST(sum(hard) AS DOUBLE) / sum(human_turns) * 10 - 1.96 * sqrt(sum(hard)) / sum(human_turns) * 10), 6) AS band_lo,
      round(CAST(sum(hard) AS DOUBLE) / sum(human_turns) * 10 + 1.96 * sqrt(sum(hard)) / sum(human_turns) * 10, 6) AS band_hi
      FROM prep WHERE NOT is_resumed AND tool_calls_total >= 1 GROUP BY anchors"""


@query("pooled_rate_by_anchors", ANCHORS_SQL)
def pooled_rate_by_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = silver.prepared(spark, sf_dir).filter("not is_resumed and tool_calls_total >= 1")
    rates = cohorts.pooled_rate(pool, ["anchors"], F.col("hard"), F.col("human_turns"))
    return rates.select("anchors", "n", "events", "turns", *_six("rate", "band_lo", "band_hi"))


@query(
    "compare_anchors",
    f"""WITH {O.PREPARED}, g AS (SELECT machine, anchors <= 1 AS few, count(*) AS n, CAST(sum(hard) AS DOUBLE) / sum(human_turns) * 10 AS rate
      FROM prep GROUP BY ALL), p AS (SELECT machine, max(rate) FILTER (few) AS w, max(rate) FILTER (NOT few) AS b,
      coalesce(max(n) FILTER (few), 0) AS wn, coalesce(max(n) FILTER (NOT few), 0) AS bn FROM g GROUP BY machine)
      SELECT machine, wn AS worse_n, bn AS better_n, round(w - b, 6) AS gap, b >= 0.5 AS can_ratio,
      CASE WHEN b >= 0.5 THEN round(w / b, 6) END AS ratio, wn >= 5 AND bn >= 5 AS enough FROM p""",
)
def compare_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = silver.prepared(spark, sf_dir).withColumn("side", F.when(F.col("anchors") <= 1, "few").otherwise("many"))
    rates = cohorts.pooled_rate(df, ["machine", "side"], F.col("hard"), F.col("human_turns"))
    out = cohorts.compare(rates, ["machine"], "side", "few", "many")
    return out.select("machine", "worse_n", "better_n", *_six("gap"), "can_ratio", *_six("ratio"), "enough")


@query(
    "clean_share",
    f"""WITH {O.PREPARED} SELECT machine, count(*) AS n, count(*) FILTER (NOT is_resumed AND tool_calls_total >= 1 AND hard = 0 AND lex_corrections = 0) AS hits,
      round(100.0::DOUBLE * count(*) FILTER (NOT is_resumed AND tool_calls_total >= 1 AND hard = 0 AND lex_corrections = 0) / count(*), 6) AS pct
      FROM prep GROUP BY machine""",
)
def clean_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.share(silver.prepared(spark, sf_dir), ["machine"], F.col("clean")).select("machine", "n", "hits", *_six("pct"))


@query(
    "median_by_machine",
    f"""WITH {O.PREPARED} SELECT machine, round(median(ctx_pct), 6) AS median_ctx_pct, CAST(median(tool_calls_total) AS DOUBLE) AS median_calls
      FROM prep GROUP BY machine""",
)
def median_by_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from turnwise.operators.ordering import medians

    df = silver.prepared(spark, sf_dir)
    a = medians(df, ["machine"], "ctx_pct", "median_ctx_pct")
    b = medians(df, ["machine"], "tool_calls_total", "median_calls")
    return a.join(b, "machine").select("machine", *_six("median_ctx_pct"), F.col("median_calls").cast("double").alias("median_calls"))


@query(
    "at_or_above_median",
    f"""WITH {O.PREPARED} SELECT session, tool_calls_total FROM prep WHERE tool_calls_total >= (SELECT median(tool_calls_total) FROM prep)""",
)
def at_or_above_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cohorts.at_or_above_median(silver.prepared(spark, sf_dir), "tool_calls_total")
    return df.select(session_number().alias("session"), "tool_calls_total")


# One SELECT per rule: (rule_id, cohort, member condition, events, denominator, scale)
_BIG = "NOT is_resumed AND tool_calls_total >= 1 AND tool_calls_total >= (SELECT median(tool_calls_total) FROM prep WHERE NOT is_resumed AND tool_calls_total >= 1)"
_PLANS = "plan_mode"
_RULE_ROWS: dict[str, list[tuple[str, int, str, str, str, float]]] = {
    "first_prompt_anchors": [
        (f"{k} of three", k, f"NOT is_resumed AND tool_calls_total >= 1 AND anchors = {k}", "hard", "human_turns", 10.0) for k in range(4)
    ],
    "long_session_knee": [
        (n, i, f"human_turns >= {lo}" + (f" AND human_turns <= {hi}" if hi else ""), "hard", "human_turns", 10.0)
        for i, (n, lo, hi) in enumerate(rules.BANDS)
    ],
    "resumed_vs_fresh": [
        ("new", 0, "tool_calls_total >= 1 AND NOT is_resumed", "hard", "human_turns", 10.0),
        ("continued", 1, "tool_calls_total >= 1 AND is_resumed", "hard", "human_turns", 10.0),
    ],
    "plan_mode_big_tasks": [
        ("plan", 0, f"{_BIG} AND {_PLANS}", "denied_user + interrupts_tool", "tool_calls_total / 10.0::DOUBLE", 10.0),
        ("straight in", 1, f"{_BIG} AND NOT {_PLANS}", "denied_user + interrupts_tool", "tool_calls_total / 10.0::DOUBLE", 10.0),
    ],
    "assistant_asked": [
        ("some questions", 0, "NOT is_resumed AND tool_calls_total >= 10 AND askuser >= 1", "interrupts + steering", "greatest(1, human_turns - askuser)", 10.0),
        ("no questions", 1, "NOT is_resumed AND tool_calls_total >= 10 AND askuser = 0", "interrupts + steering", "greatest(1, human_turns - askuser)", 10.0),
    ],
    "tool_output_bloat": [],
    "cache_resets": [
        ("rebuilt", 0, "tool_calls_total >= 10 AND cache_resets >= 1", "cache_writes", "input_tokens", 100.0),
        ("kept", 1, "tool_calls_total >= 10 AND cache_resets = 0", "cache_writes", "input_tokens", 100.0),
    ],
    "first_prompt_score": [
        (f"{lo}-{hi}", i, f"score BETWEEN {lo} AND {hi} AND tool_calls_total >= 1", "hard", "human_turns", 10.0)
        for i, (lo, hi) in enumerate(((0, 1), (2, 3), (4, 5)))
    ],
    "correction_causes": [],
    "missing_ingredient_cost": [
        (f"{item}: {side}", i * 2 + j, f"score IS NOT NULL AND {neg} ((length('{item}') + doc_id) % 3 = 0)", "hard", "human_turns", 10.0)
        for i, item in enumerate(rules.fixed.MISSING_ITEMS)
        for j, (side, neg) in enumerate((("absent", ""), ("present", "NOT")))
    ],
}


def _group_sql(rule_id: str, places: int = 6) -> str:
    parts = []
    for cohort, ord_, where, events, per, scale in _RULE_ROWS[rule_id]:
        e, t = f"coalesce(sum({events}) FILTER ({where}), 0)::DOUBLE", f"coalesce(sum({per}) FILTER ({where}), 0)::DOUBLE"
        half = f"1.96 * sqrt({e}) / {t} * 10" if scale == 10.0 else "0"
        rate = f"{e} / {t} * {scale}"
        lo = f"greatest(0.0::DOUBLE, {rate} - {half})"
        parts.append(
            f"SELECT '{rule_id}' AS rule_id, '{cohort}' AS cohort, {ord_} AS ord, count(*) FILTER ({where}) AS n, {e} AS events, {t} AS turns, "
            f"CASE WHEN {t} = 0 THEN 0 ELSE round(({rate})::DOUBLE, {places}) END AS rate, CASE WHEN {t} = 0 THEN 0 ELSE round(({lo})::DOUBLE, {places}) END AS band_lo, "
            f"CASE WHEN {t} = 0 THEN 0 ELSE round(({rate} + {half})::DOUBLE, {places}) END AS band_hi, count(*) FILTER ({where}) < 5 AS too_small FROM prep"
        )
    return " UNION ALL ".join(parts)


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The one pass gives every rule; each query below reads its own rows of it.
    p = silver.prepared(spark, sf_dir)
    groups = rules.finding_groups(rules.cohort_groups(p))
    return groups.select("rule_id", "cohort", "ord", "n", "events", "turns", *_six("rate", "band_lo", "band_hi"), "too_small")


@query(
    "rule_groups",
    f"WITH {O.PREPARED} " + " UNION ALL ".join(_group_sql(r) for r in rules.RULE_IDS if _RULE_ROWS[r]),
)
def rule_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir)


_BASE = f"WITH {O.PREPARED}, g AS (" + " UNION ALL ".join(_group_sql(r, 15) for r in rules.RULE_IDS if _RULE_ROWS[r]) + ")"
_MISS = "regexp_replace(w.cohort, ': absent$', '')"


def _pair_sql(rule_id: str, worse: str, better: str, extra: str = "true", pool: str = "", n: str = "") -> str:
    """Fired flag, effect, reach and score of a two-cohort rule."""
    return (
        f"SELECT '{rule_id}' AS rule_id, w.n >= 5 AND b.n >= 5 AND w.rate - b.rate > 0 AND ({extra}) AS fired, w.n AS worse_n, b.n AS better_n, "
        f"w.rate - b.rate AS gap, CASE WHEN b.rate >= 0.5 THEN least(2.0::DOUBLE, w.rate / b.rate - 1) ELSE (w.rate - b.rate) / 2 END AS effect, "
        f"w.n::DOUBLE / greatest(1, {pool}) AS reach, {n or pool} AS n FROM ({worse}) w, ({better}) b"
    )


def _cohort_sql(rule_id: str, cohort: str) -> str:
    return f"SELECT * FROM g WHERE rule_id = '{rule_id}' AND cohort = '{cohort}'"


def _count_sql(where: str) -> str:
    return f"(SELECT count(*) FROM prep WHERE {where})"


def _merged_sql(rule_id: str, where: str) -> str:
    return (
        f"SELECT '' AS cohort, count(*) AS n, coalesce(sum(hard)::DOUBLE / nullif(sum(human_turns), 0) * 10, 0) AS rate FROM prep "
        f"WHERE NOT is_resumed AND tool_calls_total >= 1 AND {where}"
    )


_FRESH = "NOT is_resumed AND tool_calls_total >= 1"
_JUDGED_N = _count_sql("score IS NOT NULL")
_PAIRS = " UNION ALL ".join(
    [
        _pair_sql("first_prompt_anchors", _merged_sql("", "anchors <= 1"), _merged_sql("", "anchors >= 2"), pool=_count_sql(_FRESH)),
        _pair_sql(
            "long_session_knee",
            "SELECT * FROM g WHERE rule_id = 'long_session_knee' AND n >= 5 ORDER BY ord DESC LIMIT 1",
            "SELECT * FROM g WHERE rule_id = 'long_session_knee' AND n >= 5 ORDER BY ord LIMIT 1",
            "(SELECT count(*) FROM g WHERE rule_id = 'long_session_knee' AND n >= 5) >= 3", _count_sql("human_turns >= 1"),
        ),
        _pair_sql("resumed_vs_fresh", _cohort_sql("resumed_vs_fresh", "continued"), _cohort_sql("resumed_vs_fresh", "new"), pool=_count_sql("tool_calls_total >= 1")),
        _pair_sql(
            "plan_mode_big_tasks", _cohort_sql("plan_mode_big_tasks", "straight in"), _cohort_sql("plan_mode_big_tasks", "plan"),
            f"{_count_sql(_FRESH)} >= 10", _count_sql(_FRESH), _count_sql(_BIG),
        ),
        _pair_sql(
            "assistant_asked", _cohort_sql("assistant_asked", "no questions"), _cohort_sql("assistant_asked", "some questions"),
            pool=_count_sql("NOT is_resumed AND tool_calls_total >= 10"),
        ),
        _pair_sql(
            "first_prompt_score", _cohort_sql("first_prompt_score", "0-1"),
            "SELECT * FROM g WHERE rule_id = 'first_prompt_score' AND ((cohort = '4-5' AND n >= 5) OR cohort = '2-3') ORDER BY ord DESC LIMIT 1",
            f"{_JUDGED_N} >= 5", _count_sql("score IS NOT NULL AND tool_calls_total >= 1"),
        ),
    ]
)
_TOOL_TOTALS = "(SELECT tool, sum(size) AS size FROM tool_rows GROUP BY tool)"
_RANKED_SQL = f"""{_BASE}, pairs AS ({_PAIRS}),
miss AS (SELECT l.n AS wn, l.rate - r.rate AS gap FROM g l JOIN g r ON l.rule_id = r.rule_id AND r.ord = l.ord + 1
         WHERE l.rule_id = 'missing_ingredient_cost' AND l.ord % 2 = 0 AND l.n >= 5 AND r.n >= 5 ORDER BY l.rate - r.rate DESC, l.ord LIMIT 1),
rest AS (
  SELECT 'tool_output_bloat' AS rule_id, pct >= 40 AND {_count_sql('ctx_pct >= 70')} >= 5 AND {_count_sql('ctx_pct < 70')} >= 5 AS fired,
         least(2.0::DOUBLE, pct / 40) AS effect, 1.0::DOUBLE AS reach, {_count_sql('true')} AS n
  FROM (SELECT max(size)::DOUBLE / sum(size) * 100 AS pct FROM {_TOOL_TOTALS})
  UNION ALL
  SELECT 'cache_resets', p >= 10 AND r >= 5, least(2.0::DOUBLE, t::DOUBLE / greatest(1, p)), r::DOUBLE / greatest(1, p), p
  FROM (SELECT count(*) AS p, count(*) FILTER (cache_resets >= 1) AS r, coalesce(sum(cache_resets), 0) AS t FROM prep WHERE tool_calls_total >= 10)
  UNION ALL
  SELECT 'correction_causes', j >= 5 AND a >= 20 AND pg * 100.0 / a >= 35, least(2.0::DOUBLE, pg * 100.0::DOUBLE / a / 35), 1.0::DOUBLE, j
  FROM (SELECT count(*) AS j, count(*) FILTER (doc_id % 2 = 0) AS a, count(*) FILTER (doc_id % 2 = 0 AND (doc_id // 2) % 5 = 0) AS pg FROM prep WHERE score IS NOT NULL)
  UNION ALL
  SELECT 'missing_ingredient_cost', {_JUDGED_N} >= 5 AND gap > 0, least(2.0::DOUBLE, gap / 2), wn::DOUBLE / {_JUDGED_N}, {_JUDGED_N} FROM miss
),
allr AS (SELECT rule_id, fired, effect, reach, n FROM pairs UNION ALL SELECT * FROM rest)
SELECT rule_id, round(effect, 6) AS effect, round(reach, 6) AS reach, n, round(effect * reach * least(1.0::DOUBLE, n / 20.0::DOUBLE), 6) AS score FROM allr WHERE fired"""


@query("ranked_findings", _RANKED_SQL)
def ranked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.rank_findings(rules.evaluate(silver.prepared(spark, sf_dir)))
    return found.select("rule_id", *_six("effect", "reach"), "n", *_six("score"))


@query(
    "locked_rules",
    _RANKED_SQL.rsplit("SELECT rule_id, round", 1)[0]
    + f"SELECT ids.rule_id FROM (VALUES {', '.join(f'({chr(39)}{r}{chr(39)})' for r in rules.RULE_IDS)}) ids(rule_id) "
    "WHERE ids.rule_id NOT IN (SELECT rule_id FROM allr WHERE fired)",
)
def locked_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.locked_rules(rules.evaluate(silver.prepared(spark, sf_dir))).select("rule_id")


for _rule in rules.RULE_IDS:
    if _RULE_ROWS[_rule]:

        def _one(spark: SparkSession, sf_dir: str, rule_id: str = _rule) -> DataFrame:
            return _groups(spark, sf_dir).filter(F.col("rule_id") == rule_id)

        query(f"rule_{_rule}", f"WITH {O.PREPARED} " + _group_sql(_rule))(_one)


@query(
    "rule_tool_output_bloat",
    f"""WITH {O.FACTS}, {O.TOOLS} SELECT tool, CAST(sum(size) AS BIGINT) AS size,
      round(100.0::DOUBLE * sum(size) / (SELECT sum(size) FROM tool_rows), 6) AS pct FROM tool_rows GROUP BY tool ORDER BY size DESC, tool LIMIT 8""",
)
def top_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = S.explode_tools(silver.prepared(spark, sf_dir), ["sid"])
    return cohorts.top_tools(sizes).select("tool", "size", *_six("pct"))


@query(
    "heavy_light_medians",
    f"""WITH {O.PREPARED} SELECT CASE WHEN ctx_pct >= 70 THEN 'window mostly full' ELSE 'window mostly free' END AS cohort,
      CAST(median(output_size) AS DOUBLE) AS median_size FROM prep GROUP BY 1""",
)
def heavy_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.heavy_light_medians(silver.prepared(spark, sf_dir)).select("cohort", F.col("median_size").cast("double").alias("median_size"))


@query(
    "rule_correction_causes",
    f"""WITH {O.PREPARED} SELECT CASE (doc_id // 2) % 5 WHEN 0 THEN 'prompt_gap' WHEN 1 THEN 'model_error' WHEN 2 THEN 'scope_change'
      WHEN 3 THEN 'env_issue' ELSE 'context_loss' END AS cause, count(*) AS n FROM prep WHERE score IS NOT NULL AND doc_id % 2 = 0 GROUP BY 1""",
)
def causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.cause_histogram(rules.verdict_turns(silver.prepared(spark, sf_dir)))


@query(
    "band_context",
    f"""WITH {O.PREPARED}, b AS (SELECT *, CASE WHEN human_turns >= 41 THEN '41+ turns' WHEN human_turns >= 16 THEN '16-40 turns'
      WHEN human_turns >= 6 THEN '6-15 turns' WHEN human_turns >= 1 THEN '1-5 turns' END AS cohort FROM prep)
      SELECT cohort, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (n_compactions > 0) / count(*), 6) AS compacted_pct,
      round(median(ctx_pct), 6) AS median_ctx_pct FROM b WHERE cohort IS NOT NULL GROUP BY cohort""",
)
def band_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.band_context(silver.prepared(spark, sf_dir)).select("cohort", "n", *_six("compacted_pct", "median_ctx_pct"))


@query(
    "compaction_verdict",
    f"""WITH {O.PREPARED}, comps AS (SELECT trunc(value * 1000) AS pre, trunc(value * 100) AS post FROM t2 WHERE is_bound),
    s AS (SELECT sum(n_compactions) AS c, sum(n_auto) AS a, count(*) FILTER (n_compactions > 0) AS sw,
                 count(*) FILTER (ctx_pct >= 80 AND n_compactions = 0) AS hot, sum(human_turns) AS t, sum(reexplain) AS re,
                 sum(turns_after_compaction) AS af, sum(reexplain_after_compaction) AS ra FROM prep),
    r AS (SELECT *, c * 100.0::DOUBLE / t AS per, a * 100.0::DOUBLE / c AS ap, ra * 100.0::DOUBLE / af AS r_after,
                 greatest(0, re - ra) * 100.0::DOUBLE / greatest(0, t - af) AS r_base,
                 (SELECT median(pre) FROM comps WHERE pre > 0) AS mp,
                 (SELECT median((pre - post) / pre * 100) FROM comps WHERE pre > 0 AND post > 0) AS md FROM s)
    SELECT CASE WHEN ra >= 10 AND af >= 10 AND sw >= 5 AND r_after >= r_base * 1.5 AND r_after >= 2 THEN 'lossy'
                WHEN c >= 8 AND (ap >= 70 OR mp >= 850000) THEN 'late, by the limit' WHEN hot >= 5 AND hot >= sw THEN 'rarely compacted'
                WHEN c < 8 THEN 'too few to say' WHEN per > 3 THEN 'frequent' ELSE 'deliberate' END AS verdict,
           CAST(c AS BIGINT) AS "count", round(per, 6) AS per_100, round(ap, 6) AS auto_pct, CAST(mp AS DOUBLE) AS med_pre, round(md, 6) AS med_drop,
           hot AS ran_hot, sw AS sessions_with, CAST(af AS BIGINT) AS "after", CAST(ra AS BIGINT) AS repeats_after,
           round(r_after, 6) AS rate_after, round(r_base, 6) AS rate_base, ra >= 10 AND af >= 10 AND sw >= 5 AS comparable FROM r""",
)
def compaction_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = rules.compaction_verdict(silver.prepared(spark, sf_dir))
    return v.select(
        # The SQL has a shorter word for the first of the verdicts.
        F.when(F.col("verdict") == "loses detail", "lossy").otherwise(F.col("verdict")).alias("verdict"), *_long("count"), *_six("per_100", "auto_pct"), F.col("med_pre").cast("double").alias("med_pre"), *_six("med_drop"),
        *_long("ran_hot", "sessions_with", "after", "repeats_after"), *_six("rate_after", "rate_base"), "comparable",
    )


# --- prices -------------------------------------------------------------------

_COST = """priced AS (SELECT session, calls.*, CASE WHEN model LIKE 'alpha-1%' THEN 5.0::DOUBLE WHEN model = 'mini-haiku-2' THEN 1.0::DOUBLE END AS p,
  CASE WHEN model LIKE 'alpha-1%' THEN 25.0::DOUBLE WHEN model = 'mini-haiku-2' THEN 5.0::DOUBLE END AS q,
  CASE WHEN model LIKE 'alpha-1%' THEN 0.5::DOUBLE WHEN model = 'mini-haiku-2' THEN 0.025::DOUBLE END AS rd FROM calls),
bym AS (SELECT session, model, any_value(p) AS p, any_value(q) AS q, any_value(rd) AS rd, count(*) AS calls, count(*) FILTER (fast) AS f, sum(tin) AS i,
  sum(cc5) AS c5, sum(cc1h) AS c1, sum(cr) AS r, sum(tout) AS o FROM priced GROUP BY session, model),
cost AS (SELECT session, coalesce(sum((i * p + c5 * p * 1.25::DOUBLE + c1 * p * 2.0::DOUBLE + r * rd + o * q) / 1e6 * (1 + f::DOUBLE / calls)) FILTER (p IS NOT NULL), 0) AS usd,
  CAST(coalesce(sum(calls) FILTER (p IS NULL), 0) AS BIGINT) AS unpriced FROM bym GROUP BY session)"""


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.explode_models(silver.prepared(spark, sf_dir), ["path"])


@query(
    "price_prefix_join",
    """SELECT model, price_id FROM (VALUES ('alpha-1', 'alpha-1'), ('alpha-1-20250101', 'alpha-1'), ('mini-haiku-2', 'mini-haiku-2'),
      ('other-9', NULL)) t(model, price_id)""",
)
def price_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = S.lifetime_totals(silver.prepared(spark, sf_dir))
    return pricing.attach_price(usage, silver.prices(spark)).select("model", "price_id")


@query("session_cost", f"WITH {O.FACTS}, {O.CALLS}, {_COST} SELECT session, {_E5_SQL.format('usd')}, unpriced FROM cost")
def session_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = pricing.session_cost(_usage(spark, sf_dir), silver.prices(spark), ["path"])
    return cost.select(session_number().alias("session"), _e5("usd"), *_long("unpriced"))


@query(
    "glance",
    f"""WITH {O.PREPARED}, {_COST} SELECT count(*) AS sessions,
      round(100.0::DOUBLE * count(*) FILTER (NOT is_resumed AND tool_calls_total >= 1 AND hard = 0 AND lex_corrections = 0) / count(*), 6) AS clean_pct,
      round(sum(hard)::DOUBLE / greatest(1, sum(human_turns)) * 10, 6) AS corrections_per_10,
      round(sum(steering)::DOUBLE / greatest(1, sum(human_turns)) * 10, 6) AS mid_run_per_10,
      round(sum(tokens)::DOUBLE / count(*), 6) AS tokens_per_session, round(sum(usd) / count(*), 6) AS usd_per_session,
      CAST(sum(unpriced) AS BIGINT) AS unpriced, CAST(sum(cache_resets) AS BIGINT) AS resets, count(score) AS reviewed
      FROM prep LEFT JOIN cost USING (session)""",
)
def glance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = pricing.session_cost(_usage(spark, sf_dir), silver.prices(spark), ["path"])
    g = rules.glance(silver.prepared(spark, sf_dir), cost)
    return g.select(
        "sessions", *_six("clean_pct", "corrections_per_10", "mid_run_per_10", "tokens_per_session", "usd_per_session"),
        *_long("unpriced", "resets", "reviewed"),
    )


@query(
    "token_panel",
    f"""WITH {O.FACTS}, {O.CALLS} SELECT model, count(*) AS calls, CAST(sum(tin) AS BIGINT) AS "in", CAST(sum(cc5 + cc1h) AS BIGINT) AS cc,
      CAST(sum(cr) AS BIGINT) AS cr, CAST(sum(tout) AS BIGINT) AS "out", CAST(sum(think) AS BIGINT) AS think,
      CAST(sum(tin + cc5 + cc1h + cr + tout) AS BIGINT) AS total FROM calls GROUP BY model""",
)
def token_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.token_panel(_usage(spark, sf_dir))


@query(
    "token_shares",
    f"""WITH {O.FACTS}, {O.CALLS} SELECT round(sum(think)::DOUBLE / greatest(1, sum(tout)) * 100, 6) AS thinking_pct,
      round(sum(cc5 + cc1h)::DOUBLE / greatest(1, sum(cc5 + cc1h + cr)) * 100, 6) AS cache_write_pct FROM calls""",
)
def token_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.token_shares(_usage(spark, sf_dir)).select(*_six("thinking_pct", "cache_write_pct"))


@query(
    "visible_sessions",
    f"""WITH {O.PREPARED}, l AS (SELECT session, max(ts) AS latest FROM facts GROUP BY session)
      SELECT session, machine FROM prep JOIN l USING (session) WHERE NOT is_resumed AND machine IN ('m0', 'm1')
      AND latest >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY""",
)
def visible_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    seen = rules.visible_sessions(silver.prepared(spark, sf_dir), now, days=7, machines=("m0", "m1"))
    return seen.select(session_number().alias("session"), "machine")


@query(
    "session_table",
    f"""WITH {O.PREPARED} SELECT 's' || CAST(session AS VARCHAR) AS sid, human_turns, hard, score, tokens, n_compactions AS compactions
      FROM prep ORDER BY score DESC NULLS LAST, sid LIMIT 25""",
)
def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = rules.session_table(silver.prepared(spark, sf_dir), key="score", limit=25)
    return t.select("sid", "human_turns", "hard", F.col("score").cast("int").alias("score"), "tokens", *_long("compactions"))


@query(
    "session_detail",
    f"""WITH {O.PREPARED}, {_COST}, d AS (SELECT session, tokens, {_E5_SQL.format('coalesce(usd, 0)')}, concat_ws(', ',
        CASE WHEN interrupts > 0 THEN interrupts || ' runs stopped' END, CASE WHEN denied_user > 0 THEN denied_user || ' calls refused' END,
        CASE WHEN denied_plan > 0 THEN denied_plan || ' plans sent back' END,
        CASE WHEN steering > 0 THEN steering || ' notes sent mid-run' END,
        CASE WHEN lex_corrections > 0 THEN lex_corrections || ' turns opening with pushback' END,
        CASE WHEN reexplain > 0 THEN reexplain || ' turns with earlier wording' END) AS sig
      FROM prep LEFT JOIN cost USING (session))
      SELECT session, tokens, usd_e5, CASE WHEN sig = '' THEN 'No signals.' ELSE 'Signals: ' || sig || '.' END AS signals FROM d""",
)
def session_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = pricing.session_cost(_usage(spark, sf_dir), silver.prices(spark), ["path"])
    d = rules.session_detail(silver.prepared(spark, sf_dir), cost)
    return d.select(session_number().alias("session"), "tokens", _e5("usd"), "signals")
