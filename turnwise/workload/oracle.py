"""The same questions in plain SQL, computed straight from the driver tables."""

FACTS = """
facts AS (
  SELECT CASE WHEN user_id % 3 = 0 THEN user_id * 3 ELSE user_id * 3 + least(2, (day(ts) - 1) // 10) END AS session,
         user_id % 3 AS machine, event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '[0-9]+') AS INT) AS k
  FROM events
)"""

TURNS = FACTS + """,
kinds AS (
  SELECT *, event_type = 'view' AS is_human,
         event_type = 'error' AND k % 3 = 0 AS is_int, event_type = 'error' AND k % 3 = 1 AS is_du,
         event_type = 'error' AND k % 3 = 2 AS is_dp, event_type = 'signup' AND k >= 25 AS is_steer,
         event_type = 'signup' AND k < 25 AS is_bound0, event_type = 'purchase' AS is_tool
  FROM facts
),
bounds AS (
  SELECT session, event_id, trunc(value * 1000) AS pre,
         lag(trunc(value * 1000)) OVER (PARTITION BY session ORDER BY event_id) AS ppre,
         k, lag(k) OVER (PARTITION BY session ORDER BY event_id) AS pk,
         row_number() OVER (PARTITION BY session ORDER BY event_id) AS rn
  FROM kinds WHERE is_bound0
),
kept AS (SELECT session, event_id FROM bounds WHERE rn = 1 OR pre <> ppre OR k <> pk),
t1 AS (
  SELECT kinds.*, kept.event_id IS NOT NULL AS is_bound,
         CAST(sum(CASE WHEN is_human THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY event_id) AS BIGINT) AS turn_no,
         lag(ts) OVER (PARTITION BY session ORDER BY event_id) AS prev_ts,
         is_human AND row_number() OVER (PARTITION BY session, k, is_human ORDER BY event_id) > 1 AS is_rep
  FROM kinds LEFT JOIN kept USING (session, event_id)
),
t2 AS (
  SELECT *, turn_no - last_value(CASE WHEN is_bound THEN turn_no END IGNORE NULLS)
                OVER (PARTITION BY session ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS since,
         is_human AND k % 7 = 0 AND turn_no > 1 AS is_lex,
         epoch_us(ts) - epoch_us(prev_ts) AS gap
  FROM t1
)"""

CALLS = """
calls AS (
  SELECT * FROM (
    SELECT session, event_id, k, ts, 10 AS tin, CAST(trunc(value * 20) AS BIGINT) AS cc5, k AS cc1h,
           CAST(trunc(value * 1000) AS BIGINT) AS cr, CAST(trunc(value * 10) AS BIGINT) AS tout,
           CAST(trunc(value * 3) AS BIGINT) AS think, k % 9 = 0 AS fast,
           CASE k % 4 WHEN 0 THEN 'alpha-1' WHEN 1 THEN 'alpha-1-20250101' WHEN 2 THEN 'mini-haiku-2' ELSE 'other-9' END AS model,
           row_number() OVER (PARTITION BY session, k ORDER BY event_id) AS rn
    FROM facts WHERE event_type = 'click')
  WHERE rn = 1
),
ctx AS (SELECT *, tin + cc5 + cc1h + cr AS c, lag(cr) OVER (PARTITION BY session ORDER BY event_id) AS prev_cr FROM calls)"""

TOOLS = """
tool_calls AS (
  SELECT session, event_id, k, CASE k % 5 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Edit' WHEN 2 THEN 'AskUserQuestion' WHEN 3 THEN 'Read' ELSE 'Skill' END AS tool,
         CAST(trunc(value * 10) AS BIGINT) AS size, k % 10 = 0 AS failed
  FROM facts WHERE event_type = 'purchase'
),
tool_rows AS (
  SELECT session, tool, 1 AS calls, CASE WHEN failed THEN 1 ELSE 0 END AS errors, size, 1 AS results FROM tool_calls
  UNION ALL
  SELECT session, 'unknown', 0, 1, CASE WHEN k % 3 = 1 THEN 2 ELSE length('User chose to stay in plan mode and continue planning') END, 1 FROM facts WHERE event_type = 'error' AND k % 3 > 0
)"""

SESSIONS = TURNS + "," + CALLS + "," + TOOLS + """,
sig AS (
  SELECT session,
    count(*) FILTER (is_human) AS human_turns,
    count(*) FILTER (is_tool AND k % 5 = 2) AS askuser,
    count(*) FILTER (is_tool) AS tool_calls_total,
    min(greatest(1, turn_no)) FILTER (is_tool AND k % 5 = 2) AS first_ask_turn,
    min(greatest(1, turn_no)) FILTER (is_tool AND k % 5 = 1) AS first_edit_turn,
    count(*) FILTER (is_int) AS interrupts,
    count(*) FILTER (is_int AND k % 2 = 0) AS interrupts_tool,
    count(*) FILTER (is_du) AS denied_user, count(*) FILTER (is_dp) AS denied_plan,
    count(*) FILTER (is_steer) AS steering, count(*) FILTER (is_lex) AS lex_corrections,
    count(*) FILTER (is_rep) AS reexplain,
    count(*) FILTER (is_rep AND since BETWEEN 1 AND 5) AS reexplain_after_compaction,
    count(*) FILTER (is_human AND since BETWEEN 1 AND 5) AS turns_after_compaction,
    count(*) FILTER (is_int AND since < 5) AS interrupts_after_compaction,
    min(greatest(1, turn_no)) FILTER (is_steer OR is_int OR is_du OR is_dp OR is_lex) AS first_correction_turn,
    CAST(coalesce(sum(gap) FILTER (gap > 0 AND gap <= 600000000), 0) AS DOUBLE) / 1000000 AS active_seconds,
    count(*) FILTER (is_bound) AS n_compactions,
    count(*) FILTER (is_bound AND k % 2 = 0) AS n_auto,
    bool_or(is_human AND k % 11 = 0) AS plan_mode,
    arg_min(k, event_id) FILTER (is_human) AS first_k
  FROM t2 GROUP BY session
),
ctx_stats AS (
  SELECT session, count(*) FILTER (prev_cr <> 0 AND cr < prev_cr * 0.5) AS cache_resets, max(c) AS ctx_peak,
         arg_max(c, event_id) AS ctx_final, arg_max(model, c * 10000000000 - event_id) AS peak_model,
         CAST(sum(tin + cc5 + cc1h + cr + tout) AS BIGINT) AS tokens,
         CAST(sum(cc5 + cc1h) AS BIGINT) AS cache_writes, CAST(sum(tin + cc5 + cc1h + cr) AS BIGINT) AS input_tokens
  FROM ctx GROUP BY session
),
outs AS (
  SELECT session, count(*) FILTER (tool = 'Bash' AND NOT failed AND k % 3 = 0) AS tests_run,
         count(*) FILTER (tool = 'Bash' AND NOT failed AND k % 3 = 1) AS git_commits,
         count(*) FILTER (tool = 'Edit') AS edits
  FROM tool_calls GROUP BY session
),
sizes AS (SELECT session, CAST(sum(size) AS BIGINT) AS output_size FROM tool_rows GROUP BY session),
sess AS (
  SELECT sig.*, coalesce(cache_resets, 0) AS cache_resets, coalesce(ctx_peak, 0) AS ctx_peak, coalesce(ctx_final, 0) AS ctx_final,
         peak_model, CASE WHEN peak_model LIKE '%haiku%' THEN 200000 ELSE 1000000 END AS ctx_window,
         coalesce(tokens, 0) AS tokens, coalesce(cache_writes, 0) AS cache_writes, coalesce(input_tokens, 0) AS input_tokens,
         coalesce(tests_run, 0) AS tests_run, coalesce(git_commits, 0) AS git_commits, coalesce(edits, 0) AS edits,
         coalesce(output_size, 0) AS output_size,
         first_k & 1 > 0 AS has_path, first_k & 2 > 0 AS has_constraint, first_k & 4 > 0 AS has_done_criterion
  FROM sig LEFT JOIN ctx_stats USING (session) LEFT JOIN outs USING (session) LEFT JOIN sizes USING (session)
)"""

PREPARED = SESSIONS + """,
items(item, ord) AS (VALUES ('files/locations', 0), ('expected output shape', 1), ('acceptance check', 2), ('constraints', 3),
                            ('current state', 4), ('scope bound', 5), ('priority', 6)),
prep AS (
  SELECT sess.*, 'm' || CAST((session // 3) % 3 AS VARCHAR) AS machine,
         session % 3 = 1 AND (session // 3) % 3 <> 0 AND EXISTS (SELECT 1 FROM sig p WHERE p.session = sess.session - 1) AS is_resumed,
         interrupts + denied_user + denied_plan AS hard,
         coalesce(CAST(has_path AS INT), 0) + coalesce(CAST(has_constraint AS INT), 0) + coalesce(CAST(has_done_criterion AS INT), 0) AS anchors,
         CAST(ctx_peak AS DOUBLE) / ctx_window * 100 AS ctx_pct,
         quality * 3 + toxic * 2 AS score, doc_id
  FROM sess LEFT JOIN labels ON labels.doc_id = sess.session
)"""
