"""Transcript lines to typed records (one row per line, one array of blocks)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise import fixed, schemas
from turnwise.functions import text as X


BLOCK_COLUMNS = (
    "pos", "btype", "text", "tool_id", "tool_name", "skill", "command", "todos", "tool_use_id", "result_chars",
    "is_error", "result_body",
)


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | text.contains(needle)
    return hit


def prefilter_lines(lines: DataFrame, markers: Sequence[str] = fixed.LINE_MARKERS, unread: bool = False) -> DataFrame:
    """Keep lines that can matter, before any JSON is parsed.

    Both ``"key":"value"`` and ``"key": "value"`` spellings count.  A line left
    out here does not touch timestamps or metadata either.  With ``unread``,
    rows without a value stay: they say what was read, not what was in it.
    """
    spellings = dict.fromkeys(s for m in markers for s in (m, m.replace('":"', '": "')))
    matters = contains_any(F.col("value"), list(spellings))
    return lines.filter(matters | F.col("value").isNull() if unread else matters)


def parse_lines(lines: DataFrame, unread: bool = False) -> DataFrame:
    """Parse each line once, against the fixed record schema.

    Fields of an unexpected type become null; an unreadable or half-written
    line has no fields at all and is dropped.
    """
    return keep_readable(with_fields(lines), unread)


def with_fields(lines: DataFrame) -> DataFrame:
    """Each line with the fields found in it as ``j``."""
    return lines.withColumn("j", F.from_json("value", schemas.RECORD))


def readable() -> Column:
    """Whether a line had any field of a record."""
    return F.coalesce("j.type", "j.sessionId", "j.timestamp", "j.cwd", "j.gitBranch", "j.entrypoint", "j.permissionMode").isNotNull()


def keep_readable(parsed: DataFrame, unread: bool = False) -> DataFrame:
    return parsed.filter(readable() | F.col("value").isNull() if unread else readable())


def count_bad_lines(lines: DataFrame) -> DataFrame:
    """How many lines each transcript lost to bad or half-written JSON."""
    return lines.groupBy("path").agg(
        F.count("*").alias("lines"),
        F.count_if(F.try_parse_json("value").isNull()).alias("bad_lines"),
    )


def typed_blocks(content: Column) -> Column:
    """Content blocks with position; null for plain-text content."""

    def block(b: Column, i: Column) -> Column:
        is_use = b["type"] == "tool_use"
        return F.struct(
            i.alias("pos"),
            b["type"].alias("btype"),
            b["text"].alias("text"),
            F.when(is_use, b["id"]).alias("tool_id"),
            F.when(is_use, F.coalesce(F.nullif(b["name"], F.lit("")), F.lit("unknown"))).alias("tool_name"),
            b["input"]["skill"].alias("skill"),
            b["input"]["command"].alias("command"),
            b["input"]["todos"].alias("todos"),
            b["tool_use_id"].alias("tool_use_id"),
            # A body that is a list arrives as its compact JSON text.
            F.coalesce(F.length(b["content"]), F.lit(4)).cast("bigint").alias("result_chars"),
            F.coalesce(b["is_error"], F.lit(False)).alias("is_error"),
            b["content"].alias("result_body"),
        )

    return F.transform(content, block)


def raw_content(value: Column) -> Column:
    """Message content as a VARIANT, for lines the fixed schema could not hold."""
    return F.try_variant_get(F.try_parse_json(value), "$.message.content", "variant")


def plain_content(raw: Column) -> Column:
    """The content when it is a plain JSON string, else null."""
    return F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(raw, "$", "string"))


def mixed_content(raw: Column) -> Column:
    """Blocks of a list that also holds other things: only its objects, read one by one."""
    items = F.filter(
        F.try_variant_get(raw, "$", "array<variant>"), lambda v: F.schema_of_variant(v).startswith("OBJECT")
    )
    return F.transform(items, lambda v: F.from_json(F.to_json(v), schemas.BLOCK_FIELDS))


def content_text(plain: Column, blocks: Column) -> Column:
    """Text content as is, or the text blocks joined by newlines."""
    parts = F.transform(
        F.filter(blocks, lambda b: (b["btype"] == "text") & b["text"].isNotNull()), lambda b: b["text"]
    )
    return F.coalesce(plain, F.array_join(parts, "\n"), F.lit(""))


def last_text(blocks: Column) -> Column:
    """The last text block of a message; null when it has none."""
    texts = F.filter(blocks, lambda b: (b["btype"] == "text") & b["text"].isNotNull())
    return F.try_element_at(F.transform(texts, lambda b: b["text"]), F.lit(-1))


def has_tool_result(blocks: Column) -> Column:
    return F.coalesce(F.exists(blocks, lambda b: F.coalesce(b["btype"] == "tool_result", F.lit(False))), F.lit(False))


def body_text(body: Column) -> Column:
    """Text of one tool-result body: the string itself, or its parts' text."""
    parts = F.from_json(body, "array<struct<text:string>>")
    listed = F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), "\n")
    return F.when(body.startswith("[") & parts.isNotNull(), listed).otherwise(body)


def result_text(blocks: Column) -> Column:
    """The text of all tool results of a record, one below the other."""
    results = F.filter(blocks, lambda b: (b["btype"] == "tool_result") & b["result_body"].isNotNull())
    return F.coalesce(F.array_join(F.transform(results, lambda b: body_text(b["result_body"])), "\n"), F.lit(""))


def interrupt_kind(text: Column, with_result: Column) -> Column:
    """``tool`` or ``run`` for an interruption, else null."""
    hit = ~with_result & X.trim_start(text).startswith(fixed.INTERRUPT_PREFIX)
    tool = F.substring(text, 1, fixed.INTERRUPT_TOOL_WITHIN).contains(fixed.INTERRUPT_TOOL_PHRASE)
    return F.when(hit, F.when(tool, "tool").otherwise("run"))


def denial_class(kind: Column, reason: Column) -> Column:
    """``user``, ``plan`` or ``auto``; null when nothing was denied."""
    return F.when(kind == "user-rejected", "user").when(
        kind != "", F.when((kind == "permission-rule") & reason.contains(fixed.PLAN_DENIAL_PHRASE), "plan").otherwise("auto")
    )


def is_steering(rtype: Column, attachment_type: Column) -> Column:
    return (rtype == "attachment") & (attachment_type == "queued_command")


def is_human_turn(c: dict[str, Column]) -> Column:
    """A message the person typed: no plumbing, no tool result, no interruption."""
    text = c["text"]
    return (
        (c["rtype"] == "user")
        & ~c["is_sidechain"]
        & ~c["is_meta"]
        & ~c["is_compact_summary"]
        & ~c["has_tool_result"]
        & F.coalesce(c["origin_kind"] == "human", F.lit(True))
        & ~X.is_blank(text)
        & ~X.trim_start(text).startswith(fixed.INTERRUPT_PREFIX)
        & ~contains_any(text, fixed.PLUMBING_MARKERS)
    )


def usage_columns(u: Column) -> Column:
    """Token counters of one API call; null when the call reports no usage."""
    parts = {
        "in_tokens": u["input_tokens"],
        "cc5": u["cache_creation"]["ephemeral_5m_input_tokens"],
        "cc1h": u["cache_creation"]["ephemeral_1h_input_tokens"],
        "cc_total": u["cache_creation_input_tokens"],
        "cr": u["cache_read_input_tokens"],
        "out": u["output_tokens"],
        "think": u["output_tokens_details"]["thinking_tokens"],
    }
    zero = F.lit(0).cast("bigint")
    counters = [(c if n == "cc_total" else F.coalesce(c, zero)).alias(n) for n, c in parts.items()]
    given = F.coalesce(*parts.values(), u["speed"]).isNotNull()
    return F.when(given, F.struct(*counters, F.coalesce(u["speed"] == "fast", F.lit(False)).alias("fast")))


def call_context(usage: Column) -> Column:
    """Tokens carried into one call; the ephemeral parts stand in for a missing total."""
    return F.coalesce(
        usage["in_tokens"] + F.coalesce(usage["cc_total"], usage["cc5"] + usage["cc1h"]) + usage["cr"],
        F.lit(0).cast("bigint"),
    )


def model_window(model: Column) -> Column:
    small = F.coalesce(F.lower(model).contains(fixed.SMALL_WINDOW_MARK), F.lit(False))
    return F.when(small, fixed.SMALL_WINDOW).otherwise(fixed.DEFAULT_WINDOW).cast("bigint")


def tool_family(name: Column) -> Column:
    return (
        F.when(name == fixed.ASK_TOOL, "ask")
        .when(name.isin(*fixed.EDIT_TOOLS), "edit")
        .when(name.isin(*fixed.PLAN_TOOLS), "plan")
        .when(name == fixed.SKILL_TOOL, "skill")
        .when(name == fixed.SHELL_TOOL, "shell")
    )


def to_records(parsed: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Typed records from parsed lines, with the columns ``carry``.  Strings stay null when absent or empty."""

    def text(path: str) -> Column:
        return F.nullif(F.col(f"j.{path}"), F.lit(""))

    def flag(path: str) -> Column:
        return F.coalesce(F.col(f"j.{path}"), F.lit(False))

    content = F.col("j.message.content")
    step = parsed.select(
        "path",
        "line_no",
        *carry,
        F.col("j.type").alias("rtype"),
        F.col("j.subtype").alias("subtype"),
        text("sessionId").alias("sid"),
        text("timestamp").alias("ts_str"),
        F.try_to_timestamp("j.timestamp").alias("ts"),
        text("cwd").alias("cwd"),
        text("gitBranch").alias("git_branch"),
        text("entrypoint").alias("entrypoint"),
        text("permissionMode").alias("permission_mode"),
        text("effort").alias("effort"),
        text("attributionSkill").alias("attribution_skill"),
        flag("isSidechain").alias("is_sidechain"),
        flag("isMeta").alias("is_meta"),
        flag("isCompactSummary").alias("is_compact_summary"),
        F.col("j.origin.kind").alias("origin_kind"),
        text("toolDenialKind").alias("denial_kind"),
        F.col("j.attachment.type").alias("attachment_type"),
        text("message.id").alias("msg_id"),
        text("message.model").alias("model"),
        usage_columns(F.col("j.message.usage")).alias("usage"),
        F.col("j.prNumber").alias("pr_number"),
        text("continuedInSessionId").alias("continued_in"),
        text("aiTitle").alias("ai_title"),
        F.struct(
            F.coalesce(text("compactMetadata.trigger"), F.lit("auto")).alias("trigger"),
            F.col("j.compactMetadata.preTokens").alias("pre"),
            F.col("j.compactMetadata.postTokens").alias("post"),
            F.col("j.compactMetadata.cumulativeDroppedTokens").alias("dropped"),
        ).alias("compact"),
        content.alias("content"),
        F.when(content.isNull() & F.col("j.type").isin("user", "assistant"), raw_content(F.col("value"))).alias("raw"),
    )
    step = step.select(
        *[c for c in step.columns if c not in ("raw", "content")],
        plain_content(F.col("raw")).alias("plain"),
        typed_blocks(F.coalesce(F.col("content"), F.when(F.col("raw").isNotNull(), mixed_content(F.col("raw"))))).alias("blocks"),
    )
    step = step.select(
        *[c for c in step.columns if c != "plain"],
        content_text(F.col("plain"), F.col("blocks")).alias("text"),
        has_tool_result(F.col("blocks")).alias("has_tool_result"),
    )
    cols = {c: F.col(c) for c in step.columns}
    is_user = cols["rtype"] == "user"
    reason = F.when(cols["denial_kind"] == "permission-rule", result_text(cols["blocks"]))
    used = ("is_meta", "is_compact_summary", "origin_kind", "blocks")
    # Bodies and block texts end here: they are most of a transcript's bytes.
    kept = [f for f in BLOCK_COLUMNS if f not in ("text", "result_body")]
    return step.select(
        *[c for c in step.columns if c not in used],
        F.transform("blocks", lambda b: F.struct(*[b[f].alias(f) for f in kept])).alias("blocks"),
        F.when(cols["rtype"] == "assistant", last_text(cols["blocks"])).alias("said"),
        F.when(is_user, denial_class(cols["denial_kind"], F.coalesce(reason, F.lit("")))).alias("denial"),
        F.when(is_user, interrupt_kind(cols["text"], cols["has_tool_result"])).alias("interrupt"),
        F.coalesce(is_human_turn(cols), F.lit(False)).alias("is_human"),
        F.coalesce(is_steering(cols["rtype"], cols["attachment_type"]), F.lit(False)).alias("is_steering"),
        F.coalesce((cols["rtype"] == "system") & (cols["subtype"] == "compact_boundary"), F.lit(False)).alias("is_boundary"),
    )


def read_records(lines: DataFrame, markers: Sequence[str] = fixed.LINE_MARKERS, carry: Sequence[str] = (), unread: bool = False) -> DataFrame:
    """Lines ``(path, line_no, value)`` to records: filter, parse, type."""
    return to_records(parse_lines(prefilter_lines(lines, markers, unread), unread), carry)


def explode_blocks(records: DataFrame, *carry: str) -> DataFrame:
    """One row per content block, with its position."""
    return records.select("path", "line_no", *carry, F.explode("blocks").alias("b")).select(
        "path", "line_no", *carry, "b.*"
    )


def extract_todos(blocks: DataFrame) -> DataFrame:
    """Real to-do list calls only; the bare tool name inside text never counts.

    The first such call of a record is the one kept.
    """
    from turnwise.operators.ordering import first_by

    calls = blocks.filter((F.col("btype") == "tool_use") & (F.col("tool_name") == fixed.TODO_TOOL) & F.col("todos").isNotNull())
    return first_by(calls.select("path", "line_no", "pos", "todos"), ["path", "line_no"], F.col("pos")).drop("pos")
