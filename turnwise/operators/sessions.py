"""Session assembly: one published row per transcript."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise import fixed
from turnwise.functions import formats, redact, text as X
from turnwise.operators import ordered, records as R
from turnwise.operators.ordered import count_if
from turnwise.operators.ordering import (
    LINES, SEGMENT_ROWS, Ordering, previous, running_max, running_min, running_sum, scan,
)
from turnwise.schemas import COUNTERS
from turnwise.session import materialize

NOTHING = -(1 << 62)
BLOCKS = Ordering(("path",), ("line_no", "pos"), f"floor(line_no / {SEGMENT_ROWS})")


def tool_count(names: Sequence[str] | None = None) -> Column:
    def hit(b: Column) -> Column:
        use = b["btype"] == "tool_use"
        return use if names is None else use & b["tool_name"].isin(*names)

    return F.coalesce(F.size(F.filter("blocks", hit)), F.lit(0)).cast("bigint")


def tool_event_array(rtype: Column, blocks: Column) -> Column:
    """A record's tool uses (of assistant records) and tool results (of user records), reduced to narrow structs."""
    is_use, is_result = rtype == "assistant", rtype == "user"
    wanted = F.filter(blocks, lambda b: (is_use & (b["btype"] == "tool_use")) | (is_result & (b["btype"] == "tool_result")))

    def narrow(b: Column) -> Column:
        classes = X.command_class(F.when(b["tool_name"] == fixed.SHELL_TOOL, b["command"]))
        return F.struct(
            b["pos"].alias("pos"), is_use.alias("is_use"),
            F.nullif(F.when(is_use, b["tool_id"]).otherwise(b["tool_use_id"]), F.lit("")).alias("id"),
            F.when(is_use, b["tool_name"]).alias("tool"),
            F.when(is_use, classes["is_test"]).alias("is_test"),
            F.when(is_use, classes["is_commit"]).alias("is_commit"),
            F.when(is_use, b["skill"]).alias("skill"),
            F.when(is_result, b["result_chars"]).alias("result_chars"),
            F.when(is_result, b["is_error"]).alias("is_error"),
        )

    return F.transform(wanted, narrow)


def record_facts(records: DataFrame) -> DataFrame:
    """All that the assembly takes from a record: flags, counters, who and where, narrow tool events.

    Texts stay for human turns only, blocks not at all, so that records are read once and everything after reads this.
    """
    is_assistant = F.col("rtype") == "assistant"
    head_hit = F.col("is_human") & X.opens_like_correction(F.col("text"), F.lit(2))
    return records.select(
        "path", "line_no", "rtype", "ts", "ts_str", "sid", "cwd", "git_branch", "entrypoint", "continued_in", "attribution_skill", "pr_number",
        "is_human", "interrupt", "denial", "is_steering", "is_boundary",
        F.when(F.col("is_human"), F.col("text")).alias("text"),
        F.when(F.col("is_boundary"), F.col("compact")).alias("compact"),
        is_assistant.alias("is_assistant"),
        F.when(is_assistant, F.col("msg_id")).alias("msg_id"),
        F.when(is_assistant, F.col("model")).alias("model"),
        F.when(is_assistant, F.col("usage")).alias("usage"),
        F.when(is_assistant, F.col("effort")).alias("effort"),
        head_hit.alias("reads_as_correction"),
        F.when(is_assistant, tool_count()).otherwise(0).alias("n_tools"),
        F.when(is_assistant, tool_count([fixed.ASK_TOOL])).otherwise(0).alias("n_ask"),
        F.when(is_assistant, tool_count(fixed.EDIT_TOOLS)).otherwise(0).alias("n_edit"),
        (
            (F.col("permission_mode").eqNullSafe("plan"))
            | F.when(is_assistant, tool_count(fixed.PLAN_TOOLS) > 0).otherwise(False)
        ).alias("plans"),
        tool_event_array(F.col("rtype"), F.col("blocks")).alias("events"),
    )


def turn_state(records: DataFrame) -> DataFrame:
    """Records with their place in the session: turn, minute, gap, boundary window."""
    return placed_facts(record_facts(records))


def placed_facts(facts: DataFrame) -> DataFrame:
    """``turn_state`` from ``record_facts``; text is a flag by now, so the scanned rows are narrow."""
    narrow = facts.select(
        "path", "line_no", "ts", "is_human", "interrupt", "denial", "is_steering", "is_boundary", F.col("ts_str").isNotNull().alias("has_ts"),
        "compact", "is_assistant", "msg_id", "model", "usage", "effort", "reads_as_correction", "n_tools", "n_ask", "n_edit", "plans",
    )
    # Plain numbers keep the segments' summaries in hash aggregates; a null among them is NOTHING.
    known = lambda c: F.coalesce(c, F.lit(NOTHING))
    at_boundary = lambda c: F.when(F.col("is_boundary"), known(F.col(c)))
    placed = scan(
        narrow,
        LINES,
        lo=running_min(F.col("ts")),
        hi=running_max(F.col("ts")),
        turn_no=running_sum(F.col("is_human").cast("bigint")),
        before=previous(F.when(F.col("has_ts"), known(F.unix_micros("ts")))),
        last_pre=previous(at_boundary("compact.pre")),
        last_dropped=previous(at_boundary("compact.dropped")),
    )
    retry = F.coalesce(
        (F.col("last_pre") == known(F.col("compact.pre"))) & (F.col("last_dropped") == known(F.col("compact.dropped"))), F.lit(False)
    )
    # A denial is noted before the turn it arrives with is counted.
    turn_before = F.col("turn_no") - F.when(F.col("is_human"), 1).otherwise(0)
    lex = F.col("reads_as_correction") & (F.col("turn_no") > 1)
    hard_mark = F.col("is_steering") | F.col("interrupt").isNotNull() | F.coalesce(F.col("denial").isin("user", "plan"), F.lit(False))
    placed = placed.withColumns(
        {
            "minutes_in": formats.minutes_between(F.col("lo"), F.col("hi")),
            "gap": ordered.gap_seconds(F.timestamp_micros(F.nullif(F.col("before"), F.lit(NOTHING))), F.col("ts")),
            "is_boundary": F.col("is_boundary") & ~retry,
            "is_lex": lex,
            "mark_turn": F.greatest(F.lit(1), F.when(hard_mark, turn_before).when(lex, F.col("turn_no"))),
        }
    ).withColumn("mark_turn", F.when(hard_mark | lex, F.col("mark_turn")))
    # Written between the two scans: each of them reads its input twice, once for the rows and once, narrow, for the segments.
    placed = materialize(placed.drop("lo", "hi", "before", "last_pre", "last_dropped", "reads_as_correction"), "placed")
    return ordered.post_boundary_window(placed, LINES, F.col("is_boundary"), "turn_no")


def api_calls(state: DataFrame) -> DataFrame:
    """One row per API call: the first record of each message id, replays ignored."""
    rows = state.filter("is_assistant").select(
        "path", "line_no", "msg_id", "model", "usage", "minutes_in",
    )
    calls = ordered.dedupe_first(rows, ["path"], "msg_id", F.col("line_no"))
    return calls.withColumn("ctx", R.call_context(F.col("usage")))


def _usage_sums(prefix: str = "usage") -> list[Column]:
    u = F.col(prefix)
    return [
        F.count("*").alias("calls"),
        F.sum(u["in_tokens"]).alias("in"),
        F.sum(u["cc5"]).alias("cc5"),
        F.sum(u["cc1h"]).alias("cc1h"),
        F.sum(u["cr"]).alias("cr"),
        F.sum(u["out"]).alias("out"),
        F.sum(u["think"]).alias("think"),
        count_if(u["fast"]).alias("fast_calls"),
    ]


def usage_by_model(calls: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Eight counters per key and model; calls without usage do not count."""
    return (
        calls.filter(F.col("usage").isNotNull())
        .groupBy(*keys, F.coalesce("model", F.lit("unknown")).alias("model"))
        .agg(*_usage_sums())
    )


def sum_counters(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def model_map(usage: DataFrame, keys: Sequence[str], out: str = "by_model") -> DataFrame:
    """The published map form: model to counters."""
    entry = F.struct("model", F.struct(*[F.col(c).alias(c) for c in COUNTERS]))
    return usage.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(out))


def context_profile(calls: DataFrame, series_points: int | None = None) -> DataFrame:
    """Context carried into calls: resets, peak, final value and the series (thinned where asked), in one scan."""
    sized = calls.filter("ctx > 0").select("path", "line_no", "model", "minutes_in", "ctx", F.col("usage.cr").alias("cr"))
    seen = scan(sized, LINES, __prev=previous(F.col("cr")), **ordered.series_folds("ctx"))
    fell = (F.col("__prev") != 0) & (F.col("cr") < F.col("__prev") * fixed.RESET_RATIO)
    return (
        seen.groupBy("path")
        .agg(
            count_if(fell).alias("cache_resets"),
            F.max("ctx").alias("ctx_peak"),
            F.max_by("model", F.struct("ctx", -F.col("line_no"))).alias("peak_model"),
            F.max_by("ctx", "line_no").alias("ctx_final"),
            *ordered.series_aggregates("minutes_in", "ctx", series_points),
        )
        .withColumn("ctx_series", ordered.series_column(series_points))
        .drop("__points", "__peak")
    )


def signal_counts(state: DataFrame, turn_minutes: int | None = None) -> DataFrame:
    """Counters of one pass over the placed records; the minutes of the first ``turn_minutes`` turns, or of all."""
    timed = F.lit(True) if turn_minutes is None else F.col("turn_no") <= turn_minutes
    human, broke = F.col("is_human"), F.col("interrupt").isNotNull()
    boundary = F.struct(
        F.col("line_no"), F.col("compact.trigger"), F.col("compact.pre"), F.col("compact.post"),
        F.col("compact.dropped"), F.col("minutes_in").alias("at_min"), F.col("turn_no").alias("turn_index"),
    )
    return state.groupBy("path").agg(
        count_if(human).alias("human_turns"),
        F.sum("n_ask").alias("askuser"),
        F.sum("n_tools").alias("tool_calls_total"),
        F.min(F.when(F.col("n_ask") > 0, F.greatest(F.lit(1), F.col("turn_no")))).alias("first_ask_turn"),
        F.min(F.when(F.col("n_edit") > 0, F.greatest(F.lit(1), F.col("turn_no")))).alias("first_edit_turn"),
        count_if(broke).alias("interrupts"),
        count_if(F.col("interrupt") == "tool").alias("interrupts_tool"),
        count_if(F.col("denial") == "user").alias("denied_user"),
        count_if(F.col("denial") == "plan").alias("denied_plan"),
        count_if(F.col("denial") == "auto").alias("denied_auto"),
        count_if(F.col("is_steering")).alias("steering"),
        count_if(F.col("is_lex")).alias("lex_corrections"),
        count_if(human & F.col("turn_in_window")).alias("turns_after_compaction"),
        count_if(broke & F.col("interrupt_in_window")).alias("interrupts_after_compaction"),
        F.min("mark_turn").alias("first_correction_turn"),
        F.bool_or("plans").alias("plan_mode"),
        F.bround(F.coalesce(F.sum("gap"), F.lit(0.0)) / 60.0, 1).alias("active_min"),
        F.max("minutes_in").alias("wall_min"),
        F.transform(
            F.array_sort(F.collect_list(F.when(human & timed, F.struct("turn_no", "minutes_in")))),
            lambda p: p["minutes_in"],
        ).alias("turn_min"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("is_boundary"), boundary))),
            lambda c: F.struct(*[c[f].alias(f) for f in ("trigger", "pre", "post", "dropped", "at_min", "turn_index")]),
        ).alias("compactions"),
    )


def repeat_counts(records: DataFrame, state: DataFrame) -> DataFrame:
    """Turns that repeat earlier wording, in all and shortly after a compaction."""
    turns = records.filter("is_human").select("path", "line_no", "text")
    flags = ordered.repeated_wording(turns, ["path"], "line_no", "text")
    placed = state.filter("is_human").select("path", "line_no", "turn_in_window")
    return (
        flags.filter("repeated")
        .join(placed, ["path", "line_no"])
        .groupBy("path")
        .agg(F.count("*").alias("reexplain"), count_if(F.col("turn_in_window")).alias("reexplain_after_compaction"))
    )


def opening_columns(text: Column) -> list[Column]:
    """Features of the opening message, and the kind of session it starts."""
    return [
        X.session_kind(text).alias("kind"),
        *[c.alias(name) for name, c in X.first_prompt_features(text).items()],
        redact.redact(X.collapse(text)).alias("fp_excerpt"),
    ]


def tool_events(records: DataFrame) -> DataFrame:
    """Tool uses and tool results as one ordered table of narrow rows."""
    return event_rows(records.select("path", "line_no", "rtype", tool_event_array(F.col("rtype"), F.col("blocks")).alias("events")))


def event_rows(facts: DataFrame) -> DataFrame:
    """``tool_events`` from ``record_facts``."""
    return facts.filter(F.col("rtype").isin("assistant", "user")).select("path", "line_no", F.inline("events"))


def tool_results(events: DataFrame) -> DataFrame:
    """Results with the tool they answer; ``unknown`` when none is pending."""
    carry = ["tool", "is_test", "is_commit"]
    matched = ordered.match_results(events.drop("skill"), BLOCKS, "id", F.col("is_use"), carry)
    loose = events.filter(~F.col("is_use") & F.col("id").isNull()).select(*matched.columns)
    return matched.unionByName(loose).withColumn("tool", F.coalesce("tool", F.lit("unknown")))


def tool_usage(events: DataFrame, results: DataFrame) -> DataFrame:
    """Calls, errors and returned size per transcript and tool."""
    zero = F.lit(0)
    fine = ~F.col("is_error")
    uses = events.filter("is_use").select(
        "path", "tool", F.lit(1).alias("n"), zero.alias("err"), zero.cast("bigint").alias("size"), zero.alias("got"),
        F.lit(False).alias("test"), F.lit(False).alias("commit"),
    )
    got = results.select(
        "path", "tool", zero.alias("n"), F.col("is_error").cast("int").alias("err"), F.col("result_chars").alias("size"), F.lit(1).alias("got"),
        (F.col("is_test") & fine).alias("test"), (F.col("is_commit") & fine).alias("commit"),
    )
    return uses.unionByName(got).groupBy("path", "tool").agg(
        F.sum("n").alias("calls"), F.sum("err").alias("errors"), F.sum("size").alias("result_chars"), F.sum("got").alias("results"),
        count_if(F.col("test")).alias("tests_run"), count_if(F.col("commit")).alias("git_commits"),
    )


def outcome_counts(results: DataFrame) -> DataFrame:
    """Shell results that ran tests or committed and did not fail."""
    fine = ~F.col("is_error")
    return results.groupBy("path").agg(
        count_if(F.col("is_test") & fine).alias("tests_run"), count_if(F.col("is_commit") & fine).alias("git_commits")
    )


def effort_counts(state: DataFrame) -> DataFrame:
    return state.filter(F.col("effort").isNotNull()).groupBy("path", "effort").agg(F.count("*").alias("n"))


def _count_map(name: str, value: str, out: str) -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias(out)


def effort_map(state: DataFrame) -> DataFrame:
    return effort_counts(state).groupBy("path").agg(_count_map("effort", "n", "effort"))


def first_sights(records: DataFrame, events: DataFrame) -> DataFrame:
    """Where each skill and each pull request of a transcript is seen first.

    A skill attributed to a record is seen before the skills it calls.
    """
    attributed = records.filter((F.col("rtype") == "assistant") & F.col("attribution_skill").isNotNull()).select(
        "path", F.lit("skill").alias("kind"), F.col("attribution_skill").alias("item"), F.struct("line_no", F.lit(-1).alias("pos")).alias("at")
    )
    called = events.filter((F.col("tool") == fixed.SKILL_TOOL) & (F.col("skill") != "")).select(
        "path", F.lit("skill").alias("kind"), F.col("skill").alias("item"), F.struct("line_no", "pos").alias("at")
    )
    links = records.filter((F.col("rtype") == "pr-link") & F.col("pr_number").isNotNull()).select(
        "path", F.lit("pr").alias("kind"), F.col("pr_number").cast("string").alias("item"), F.struct("line_no", F.lit(0).alias("pos")).alias("at")
    )
    return attributed.unionByName(called).unionByName(links).groupBy("path", "kind", "item").agg(F.min("at").alias("at"))


def _seen(kind: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "item"))))
    return F.transform(pairs, lambda p: p["item"])


def _sighted() -> list[Column]:
    return [_seen("skill").alias("skills"), _seen("pr").cast("array<bigint>").alias("pr_numbers")]


def sighted_sets(records: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct skills and pull requests, each in order of first sight."""
    return first_sights(records, events).groupBy("path").agg(*_sighted())


def published_maps(by_model: DataFrame, usage: DataFrame, efforts: DataFrame, sights: DataFrame) -> DataFrame:
    """The published maps and lists of a transcript from its rows per model, tool, effort, and skill or pull request.

    All four meet in one shuffle of rows that are aggregated already; a map without rows is null.
    """
    rows = (
        by_model.withColumns({"kind": F.lit("model"), "item": F.col("model")}).drop("model").withColumnRenamed("calls", "model_calls")
        .unionByName(usage.withColumns({"kind": F.lit("tool"), "item": F.col("tool")}).drop("tool"), allowMissingColumns=True)
        .unionByName(efforts.select("path", F.lit("effort").alias("kind"), F.col("effort").alias("item"), "n"), allowMissingColumns=True)
        .unionByName(sights, allowMissingColumns=True)
    )

    def mapped(kind: str, value: Column, out: str, keep: Column | None = None) -> Column:
        of_kind = F.col("kind") == kind
        entries = F.array_sort(F.collect_list(F.when(of_kind if keep is None else of_kind & keep, F.struct("item", value.alias("value")))))
        return F.when(F.count_if(of_kind) > 0, F.map_from_entries(entries)).alias(out)

    counters = F.struct(*[F.col("model_calls" if c == "calls" else c).alias(c) for c in COUNTERS])
    return rows.groupBy("path").agg(
        mapped("model", counters, "by_model"),
        mapped("tool", F.col("calls"), "tools", F.col("calls") > 0),
        mapped("tool", F.col("errors"), "tool_err", F.col("errors") > 0),
        mapped("tool", F.col("result_chars"), "tool_bytes", F.col("results") > 0),
        F.sum("tests_run").alias("tests_run"), F.sum("git_commits").alias("git_commits"),
        mapped("effort", F.col("n"), "effort"), *_sighted(),
    )


def session_meta(records: DataFrame) -> DataFrame:
    """Who and where: last non-empty values win, the session id is the first one."""
    where = F.col("line_no")

    def last(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), where)).alias(c)

    return records.groupBy("path").agg(
        F.min_by("sid", F.when(F.col("sid").isNotNull(), where)).alias("sid"),
        last("cwd"), last("git_branch"), last("entrypoint"),
        F.min_by("ts_str", "ts").alias("started_ts"),
        F.max_by("ts_str", "ts").alias("latest_ts"),
        F.max("ts").alias("latest_at"),
        F.max_by("continued_in", F.when(F.col("rtype") == "continued-in", where)).alias("continued_in"),
        F.min_by("text", F.when(F.col("is_human"), where)).alias("opening"),
    )


def build_sessions(
    records: DataFrame,
    subagents: DataFrame | None = None,
    publish_excerpt: bool = False,
    deny: DataFrame | None = None,
    series_points: int | None = None,
    turn_minutes: int | None = None,
) -> DataFrame:
    """One row per transcript (two files with one session id are two rows).

    Lists are whole unless a length is given.  The excerpt is the opening
    message with key patterns and the values of ``deny`` taken out, then cut.

    ``records`` are read once.  Their facts, the placed facts and the
    de-duplicated calls are written, since several aggregates read each.
    """
    facts = materialize(record_facts(records), "record_facts")
    state = materialize(placed_facts(facts), "turn_state")
    calls = materialize(api_calls(state), "api_calls")
    events = event_rows(facts)
    usage = tool_usage(events, tool_results(events))
    parts = [
        session_meta(facts), signal_counts(state, turn_minutes), repeat_counts(facts, state), context_profile(calls, series_points),
        published_maps(usage_by_model(calls), usage, effort_counts(state), first_sights(facts, events)),
    ]
    out = reduce(lambda a, b: a.join(b, "path", "left"), parts)
    kept = [c for c in out.columns if c != "opening"]
    out = out.select(*kept, *opening_columns(F.col("opening")))
    zeros = (
        "reexplain", "reexplain_after_compaction", "cache_resets", "ctx_peak", "ctx_final", "tests_run", "git_commits",
    )
    empty = {"ctx_series": "array<struct<min:double,ctx:bigint>>", "skills": "array<string>", "pr_numbers": "array<bigint>"}
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zeros}).withColumns(
        {c: F.coalesce(c, F.array().cast(t)) for c, t in empty.items()}
    ).withColumn("ctx_window", R.model_window(F.col("peak_model")))
    out = out.filter(F.col("sid").isNotNull())
    if publish_excerpt:
        if deny is not None:
            out = redact.redact_listed(out, "fp_excerpt", deny)
        out = out.withColumn("fp_excerpt", F.substring("fp_excerpt", 1, fixed.EXCERPT_CHARS))
    else:
        out = out.drop("fp_excerpt")
    return attach_subagents(out, rollup_subagents(subagents)) if subagents is not None else out


def build_subagents(records: DataFrame) -> DataFrame:
    """Usage per delegated transcript and model: once per message id."""
    rows = records.filter("rtype = 'assistant'").select("path", "line_no", "msg_id", "model", "usage")
    return usage_by_model(ordered.dedupe_first(rows, ["path"], "msg_id", F.col("line_no")))


def subagent_totals(files: DataFrame, records: DataFrame) -> DataFrame:
    """Tool calls per delegated transcript; files ``(path, parent_sid, agent_type)`` all stay."""
    tools = records.filter("rtype = 'assistant'").groupBy("path").agg(F.sum(tool_count()).alias("tool_calls"))
    return files.join(tools, "path", "left").withColumns(
        {"tool_calls": F.coalesce("tool_calls", F.lit(0)), "agent_type": F.coalesce(F.nullif("agent_type", F.lit("")), F.lit("unknown"))}
    ).join(model_map(build_subagents(records), ["path"]), "path", "left")


def rollup_subagents(subagents: DataFrame) -> DataFrame:
    """Per parent session: how many, of which types, their tokens and tool calls."""
    whole = subagents.groupBy("parent_sid").agg(F.count("*").alias("n"), F.sum("tool_calls").alias("tool_calls"))
    typed = subagents.groupBy("parent_sid", "agent_type").agg(F.count("*").alias("k"))
    by_type = typed.groupBy("parent_sid").agg(_count_map("agent_type", "k", "by_type"))
    long = explode_models(subagents, ["parent_sid"])
    by_model = model_map(sum_counters(long, ["parent_sid", "model"]), ["parent_sid"])
    return whole.join(by_type, "parent_sid", "left").join(by_model, "parent_sid", "left")


def attach_subagents(sessions: DataFrame, rollup: DataFrame) -> DataFrame:
    """Left join of the roll-up on session id; sessions without one get nulls."""
    packed = rollup.select(F.col("parent_sid").alias("sid"), F.struct("n", "by_type", "by_model", "tool_calls").alias("subagents"))
    return sessions.join(packed, "sid", "left")


def explode_models(sessions: DataFrame, keys: Sequence[str], col: str = "by_model") -> DataFrame:
    """The published model map as long rows."""
    return sessions.select(*keys, F.explode(col).alias("model", "u")).select(*keys, "model", "u.*")


def explode_tools(sessions: DataFrame, keys: Sequence[str], col: str = "tool_bytes", out: str = "size") -> DataFrame:
    return sessions.select(*keys, F.explode(col).alias("tool", out))


def link_resumes(sessions: DataFrame) -> DataFrame:
    """Mark sessions that another one continued into.

    The last predecessor by path names it; when two files carry one session id,
    the later file is the one marked.
    """
    named = sessions.filter(F.col("continued_in").isNotNull()).groupBy(F.col("continued_in").alias("sid")).agg(
        F.max_by("sid", "path").alias("resumed_from")
    )
    target = sessions.groupBy("sid").agg(F.max("path").alias("path")).join(named, "sid")
    return sessions.join(target, ["sid", "path"], "left")


def attach_verdicts(sessions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Left join of the review verdict as struct ``j``."""
    packed = verdicts.select("sid", F.struct(*[c for c in verdicts.columns if c != "sid"]).alias("j"))
    return sessions.join(packed, "sid", "left")


def tokens_of(by_model: Column) -> Column:
    """All tokens of a session; delegated work is counted with the subagents."""
    return F.aggregate(
        F.coalesce(F.map_values(by_model), F.array()),
        F.lit(0).cast("bigint"),
        lambda n, u: n + u["in"] + u["cc5"] + u["cc1h"] + u["cr"] + u["out"],
    )


def session_measures(sessions: DataFrame) -> DataFrame:
    """Derived columns the statistics work on."""
    def flag(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False))

    hard = F.col("interrupts") + F.col("denied_user") + F.col("denied_plan")
    resumed = F.col("resumed_from").isNotNull()
    did_edit = F.lit(False)
    for name in fixed.EDIT_TOOLS:
        did_edit = did_edit | (F.coalesce(F.try_element_at("tools", F.lit(name)), F.lit(0)) > 0)
    return sessions.withColumns(
        {
            "hard": hard,
            "anchors": flag("has_path").cast("int") + flag("has_constraint").cast("int") + flag("has_done_criterion").cast("int"),
            "is_resumed": resumed,
            "edited": (F.col("git_commits") > 0) | did_edit,
            "ctx_pct": F.when(F.col("ctx_window") > 0, F.col("ctx_peak") / F.col("ctx_window") * 100).otherwise(0.0),
            "clean": ~resumed & (F.col("tool_calls_total") >= 1) & (hard == 0) & (F.col("lex_corrections") == 0),
            "tokens": tokens_of(F.col("by_model")),
        }
    )


def lifetime_totals(sessions: DataFrame) -> DataFrame:
    """Counters per model over every session, whatever its age."""
    return sum_counters(explode_models(sessions, []), ["model"])


def recent(sessions: DataFrame, now: Column, days: int | None = None) -> DataFrame:
    """Sessions inside the feed window of so many days; all without one."""
    return sessions if days is None else sessions.filter(F.col("latest_at") >= formats.days_before(now, days))


def review_cost(sessions: DataFrame) -> DataFrame:
    """Tokens spent by the reviewing sessions themselves."""
    spent = sessions.filter("kind = 'judge'").select(tokens_of(F.col("by_model")).alias("t"))
    return spent.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("judge_tokens"))
