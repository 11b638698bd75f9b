"""The driver's ``events`` table rendered as transcript lines.

Every event becomes one or two JSON records, so the session queries run the
whole path: prefilter, parse, typed records, ordered scans, assembly.

============  =================================================================
event type    record
============  =================================================================
view          human turn; the wording carries ``k``, anchors by bits of ``k``
click         API call; the message id repeats with ``k``, so replays occur
purchase      tool use and its result (two lines)
error         interruption, user denial or plan denial, by ``k % 3``
signup        compaction when ``k < 25``, else a message sent mid-run
============  =================================================================

``path`` is the session (a user, or a third of a user's month) and ``line_no``
is the append order of the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise import fixed
from turnwise.session import spread

SESSION_KEY = "CASE WHEN user_id % 3 = 0 THEN user_id * 3 ELSE user_id * 3 + least(2, {day_div}) END"
TOOLS = ("Bash", "Edit", "AskUserQuestion", "Read", "Skill")
MODELS = ("alpha-1", "alpha-1-20250101", "mini-haiku-2", "other-9")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_facts(events: DataFrame) -> DataFrame:
    """Typed view of the events with session id and ``k``."""
    k = F.get_json_object("props", "$.k").cast("int")
    session = F.expr(SESSION_KEY.format(day_div="(day(ts) - 1) div 10"))
    return events.select(
        session.cast("bigint").alias("session"), (F.col("user_id") % 3).alias("machine"),
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", k.alias("k"),
    )


def _pick(values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("k") % len(values) + 1).cast("int"))


def event_lines(events: DataFrame) -> DataFrame:
    """``(path, line_no, value)`` lines; narrow, one pass, no shuffle."""
    e = event_facts(spread(events))
    k, ks = F.col("k"), F.concat(F.lit("k"), F.col("k").cast("string"))
    text = F.concat(
        F.when(k % 7 == 0, "No, ").otherwise(""),
        F.format_string("work %s on list %s now", ks, ks),
        F.when(k.bitwiseAND(1) > 0, F.format_string(" in src/app.py %s", ks)).otherwise(""),
        F.when(k.bitwiseAND(2) > 0, F.format_string(" do not %s widen", ks)).otherwise(""),
        F.when(k.bitwiseAND(4) > 0, F.format_string(" then verify %s ok", ks)).otherwise(""),
    )

    def whole(factor: int) -> Column:
        return (F.col("value") * factor).cast("bigint")

    def entry(name: str, value: Column) -> Column:
        return value.alias(name)

    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    common = [
        entry("timestamp", stamp),
        entry("sessionId", F.concat(F.lit("s"), F.col("session").cast("string"))),
        entry("cwd", F.concat(F.lit("/home/u/p"), (F.col("session") % 7).cast("string"))),
    ]

    def line(kind: str, *fields: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("type"), *common, *fields))

    def message(*fields: Column) -> Column:
        return F.struct(*fields).alias("message")

    def result(tool_id: Column, body: Column, failed: Column) -> Column:
        return F.array(
            F.struct(
                F.lit("tool_result").alias("type"), tool_id.alias("tool_use_id"), body.alias("content"), failed.alias("is_error")
            )
        ).alias("content")

    view = line(
        "user",
        F.when(k % 11 == 0, "plan").alias("permissionMode"),
        message(F.lit("user").alias("role"), text.alias("content")),
    )
    click = line(
        "assistant",
        F.when(k % 3 == 0, "high").otherwise("low").alias("effort"),
        message(
            ks.alias("id"), _pick(MODELS).alias("model"), F.array().cast("array<string>").alias("content"),
            F.struct(
                F.lit(10).alias("input_tokens"),
                whole(1000).alias("cache_read_input_tokens"),
                whole(10).alias("output_tokens"),
                F.struct(whole(20).alias("ephemeral_5m_input_tokens"), k.alias("ephemeral_1h_input_tokens")).alias("cache_creation"),
                F.struct(whole(3).alias("thinking_tokens")).alias("output_tokens_details"),
                F.when(k % 9 == 0, "fast").alias("speed"),
            ).alias("usage"),
        ),
    )
    tool_id = F.concat(F.lit("t"), F.col("event_id").cast("string"))
    command = F.when(k % 3 == 0, "python -m pytest -q").when(k % 3 == 1, "git  commit -m x").otherwise("ls")
    use = line(
        "assistant",
        message(
            F.array(
                F.struct(
                    F.lit("tool_use").alias("type"), tool_id.alias("id"), _pick(TOOLS).alias("name"),
                    F.struct(command.alias("command"), F.concat(F.lit("skill"), (k % 4).cast("string")).alias("skill")).alias("input"),
                )
            ).alias("content")
        ),
    )
    answer = line("user", message(result(tool_id, F.repeat(F.lit("x"), whole(10).cast("int")), k % 10 == 0)))
    tail = F.when(k % 2 == 0, " for tool use]").otherwise("]")
    interrupt = line("user", message(F.concat(F.lit(fixed.INTERRUPT_PREFIX), tail).alias("content")))
    denied_user = line(
        "user", F.lit("user-rejected").alias("toolDenialKind"), message(result(F.lit("none"), F.lit("no"), F.lit(True)))
    )
    denied_plan = line(
        "user", F.lit("permission-rule").alias("toolDenialKind"),
        message(result(F.lit("none"), F.lit(fixed.PLAN_DENIAL_PHRASE), F.lit(True))),
    )
    compaction = line(
        "system", F.lit("compact_boundary").alias("subtype"),
        F.struct(
            F.when(k % 2 == 0, "auto").otherwise("manual").alias("trigger"),
            whole(1000).alias("preTokens"), whole(100).alias("postTokens"), k.alias("cumulativeDroppedTokens"),
        ).alias("compactMetadata"),
    )
    steering = line("attachment", F.struct(F.lit("queued_command").alias("type")).alias("attachment"))
    kind = F.col("event_type")
    lines = (
        F.when(kind == "view", F.array(view))
        .when(kind == "click", F.array(click))
        .when(kind == "purchase", F.array(use, answer))
        .when((kind == "error") & (k % 3 == 0), F.array(interrupt))
        .when((kind == "error") & (k % 3 == 1), F.array(denied_user))
        .when(kind == "error", F.array(denied_plan))
        .when((kind == "signup") & (k < 25), F.array(compaction))
        .otherwise(F.array(steering))
    )
    return e.select("session", "event_id", F.posexplode(lines).alias("i", "value")).select(
        F.format_string("/logs/p/%012d.jsonl", "session").alias("path"),
        (F.col("event_id") * 2 + F.col("i")).alias("line_no"),
        "value",
    )
