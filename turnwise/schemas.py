"""Schemas of the typed tables."""

TODO = "STRUCT<content: STRING, status: STRING>"
USAGE = (
    "STRUCT<input_tokens: BIGINT, cache_read_input_tokens: BIGINT, output_tokens: BIGINT, "
    "cache_creation_input_tokens: BIGINT, "
    "cache_creation: STRUCT<ephemeral_5m_input_tokens: BIGINT, ephemeral_1h_input_tokens: BIGINT>, "
    "output_tokens_details: STRUCT<thinking_tokens: BIGINT>, speed: STRING>"
)
BLOCK_FIELDS = (
    "type STRING, text STRING, id STRING, name STRING, "
    f"input STRUCT<skill: STRING, command: STRING, todos: ARRAY<{TODO}>>, "
    "tool_use_id STRING, content STRING, is_error BOOLEAN"
)
BLOCK = (
    "STRUCT<type: STRING, text: STRING, id: STRING, name: STRING, "
    f"input: STRUCT<skill: STRING, command: STRING, todos: ARRAY<{TODO}>>, "
    "tool_use_id: STRING, content: STRING, is_error: BOOLEAN>"
)
# One transcript line.  ``message.content`` may also be a plain string; it then
# reads as null here and is taken from the line itself.
RECORD = (
    "type STRING, subtype STRING, timestamp STRING, sessionId STRING, cwd STRING, gitBranch STRING, "
    "entrypoint STRING, permissionMode STRING, effort STRING, attributionSkill STRING, "
    "isSidechain BOOLEAN, isMeta BOOLEAN, isCompactSummary BOOLEAN, origin STRUCT<kind: STRING>, "
    "toolDenialKind STRING, attachment STRUCT<type: STRING>, prNumber BIGINT, "
    "continuedInSessionId STRING, aiTitle STRING, "
    "compactMetadata STRUCT<trigger: STRING, preTokens: BIGINT, postTokens: BIGINT, cumulativeDroppedTokens: BIGINT>, "
    f"message STRUCT<id: STRING, model: STRING, usage: {USAGE}, content: ARRAY<{BLOCK}>>"
)
COMPACTION = "STRUCT<trigger: STRING, pre: BIGINT, post: BIGINT, dropped: BIGINT, at_min: DOUBLE, turn_index: BIGINT>"

COUNTERS = ("calls", "in", "cc5", "cc1h", "cr", "out", "think", "fast_calls")
MODEL_USAGE = "STRUCT<" + ", ".join(f"`{c}`: BIGINT" for c in COUNTERS) + ">"

VERDICT = (
    "sid STRING, n_turns BIGINT, judged_by STRING, "
    "turns ARRAY<STRUCT<i: BIGINT, label: STRING, cause: STRING>>, "
    "first_prompt STRUCT<goal: BOOLEAN, context: BOOLEAN, constraints: BOOLEAN, done_criterion: BOOLEAN, scope: BOOLEAN>, "
    "score BIGINT, missing ARRAY<STRING>, outcome STRING, summary STRING"
)
LIVE = "sessionId STRING, cwd STRING, startedAt DOUBLE, name STRING"
NOTE = "date STRING, judged_total BIGINT, notes ARRAY<STRUCT<pattern: STRING, advice: STRING, prompt_shape: STRING>>"
OVERLAY_LOG = "level STRING, key STRING, field STRING, value STRING, at TIMESTAMP"
