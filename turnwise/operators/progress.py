"""Progress: to-do lists rolled up to sessions (stages), projects and machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise import fixed
from turnwise.functions import formats, redact, text as X
from turnwise.operators.ordered import count_if
from turnwise.operators.ordering import first_by
from turnwise.operators.records import explode_blocks, extract_todos

STAGE = ["project_key", "stage_key"]
PROGRESS_MARKERS = ('"type":"assistant"', '"type":"user"', fixed.TITLE_MARKER, '"timestamp"')


def latest_progress(records: DataFrame) -> DataFrame:
    """Per transcript: newest to-do list, title and metadata; earliest timestamp."""
    where = F.col("line_no")
    spoken = F.col("rtype").isin("assistant", "user") & F.col("sid").isNotNull()
    meta = F.struct("sid", "cwd", "git_branch", F.col("ts_str").alias("latest_ts"), F.col("ts").alias("latest_at"))
    base = records.groupBy("path").agg(
        F.max_by(meta, F.when(spoken, where)).alias("m"),
        F.max_by("ai_title", F.when(F.col("rtype") == "ai-title", where)).alias("ai_title"),
        F.min_by("ts_str", "ts").alias("started_ts"),
        F.min("ts").alias("started_at"),
    )
    todos = extract_todos(explode_blocks(records.filter("rtype = 'assistant'")))
    newest = todos.groupBy("path").agg(F.max_by("todos", "line_no").alias("todos"))
    return base.join(newest, "path", "left").select(
        "path", "m.*", "ai_title", "started_ts", "started_at",
        F.coalesce("todos", F.array().cast("array<struct<content:string,status:string>>")).alias("todos"),
    )


def normal_path(path: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(path, "/(\\./)+", "/"), "/+", "/")
    return F.when(flat == "/", flat).otherwise(F.regexp_replace(flat, "/\\.?$", ""))


def project_root(cwds: DataFrame, repo_roots: DataFrame, home: str) -> DataFrame:
    """``(cwd, root)`` for each distinct ``cwd``: nearest listed ancestor, else the
    first folder under home, else the path itself.

    Ancestors of distinct paths are exploded and equi-joined, so the list of
    repositories may be as large as it likes.
    """
    paths = cwds.select("cwd").filter("cwd != ''").distinct().withColumn("norm", normal_path(F.col("cwd")))
    parts = F.split("norm", "/")
    depth = F.sequence(F.lit(1), F.size(parts))
    ancestor = F.explode(F.transform(depth, lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    listed = repo_roots.select(normal_path(F.col("root")).alias("ancestor")).distinct()
    nearest = (
        paths.select("cwd", ancestor.alias("ancestor"))
        .withColumn("ancestor", F.when(F.col("ancestor") == "", "/").otherwise(F.col("ancestor")))
        .join(listed, "ancestor")
        .groupBy("cwd")
        .agg(F.max_by("ancestor", F.length("ancestor")).alias("nearest"))
    )
    under = F.substring_index(F.expr(f"substring(norm, {len(home) + 2})"), "/", 1)
    fallback = F.when(F.col("norm").startswith(f"{home}/"), F.concat(F.lit(f"{home}/"), under)).otherwise(F.col("norm"))
    return paths.join(nearest, "cwd", "left").select("cwd", F.coalesce("nearest", fallback).alias("root"))


def todo_progress(subtasks: DataFrame, keys: list[str]) -> DataFrame:
    """Done, total and percent to one place (null when there is nothing to do)."""
    counted = subtasks.groupBy(*keys).agg(
        count_if(F.col("status") == "completed").alias("num_done"), F.count("*").alias("num_todos"),
        F.bool_or(F.col("status") == "in_progress").alias("has_doing"),
    )
    return counted.withColumn("progress", percent(F.col("num_done"), F.col("num_todos")))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.bround(done * 100.0 / total, 1))


def attach_live(stages: DataFrame, live: DataFrame) -> DataFrame:
    """Running flag, name and start of the current run from the live registry."""
    reg = first_by(live.filter(F.col("sessionId") != "").withColumnRenamed("sessionId", "sid"), ["sid"], F.col("startedAt"))
    slim = reg.select(
        "sid", F.lit(True).alias("__live"), F.nullif("name", F.lit("")).alias("live_name"),
        formats.epoch_millis(F.col("startedAt")).alias("run_started_at"),
    )
    return stages.join(slim, "sid", "left").withColumn("running", F.coalesce("__live", F.lit(False))).drop("__live")


def display_names(stages: DataFrame) -> DataFrame:
    """Project name, place inside the project, and a title that is never empty."""
    sub = F.when(F.col("cwd") == F.col("root"), "").otherwise(F.expr("substring(cwd, length(root) + 2)"))
    return stages.withColumns(
        {
            "project": X.basename(F.col("root")),
            "subpath": sub,
            "title": F.coalesce(F.nullif("ai_title", F.lit("")), "live_name", F.lit(fixed.UNTITLED)),
            "branch": X.shown_branch(F.col("git_branch")),
        }
    )


def build_progress(
    latest: DataFrame, roots: DataFrame, live: DataFrame, machine: str, deny: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(stages, subtasks)`` of one machine, redacted by pattern and by ``deny``, from ``latest_progress``."""
    def clean(df: DataFrame, col: str) -> DataFrame:
        return df if deny is None else redact.redact_listed(df, col, deny)

    placed = latest.filter("cwd != '' and sid != ''").join(roots, "cwd")
    named = display_names(attach_live(placed, live)).withColumns(
        {"machine": F.lit(machine), "project_key": F.concat(F.lit(f"{machine}::"), "root"), "stage_key": F.col("sid")}
    )
    subtasks = named.select(*STAGE, "machine", F.posexplode("todos").alias("pos", "t")).select(
        *STAGE, "machine", "pos", X.fingerprint(F.col("t.content")).alias("subtask_key"),
        redact.redact(F.coalesce("t.content", F.lit(""))).alias("text"), F.coalesce("t.status", F.lit("pending")).alias("status"),
    )
    subtasks = clean(subtasks, "text")
    done = F.size(F.filter("todos", lambda t: t["status"] == "completed")).cast("bigint")
    total = F.size("todos").cast("bigint")
    stages = named.select(
        *STAGE, "machine", "project", "root", redact.redact(F.col("title")).alias("title"), "running", "latest_at", "started_at",
        "run_started_at", "branch", "subpath", done.alias("num_done"), total.alias("num_todos"),
        percent(done, total).alias("progress"),
        F.exists("todos", lambda t: F.coalesce(t["status"] == "in_progress", F.lit(False))).alias("has_doing"),
    )
    return mark_foreground(clean(stages, "title")), subtasks


def mark_foreground(stages: DataFrame) -> DataFrame:
    """One working-now stage over all machines: running, newest activity, first key on ties.

    Keyed by machine, project and stage, so equal stage keys elsewhere stay dark.
    """
    where = F.struct("machine", *STAGE)
    newest = stages.filter("running and latest_at is not null").agg(F.max("latest_at")).scalar()
    first = stages.filter(F.col("running") & (F.col("latest_at") == newest)).agg(F.min(where)).scalar()
    return stages.withColumn("foreground", F.coalesce(where == first, F.lit(False)))


def stage_state(stages: DataFrame) -> DataFrame:
    doing = F.col("has_doing") | F.coalesce(F.col("progress") > 0, F.lit(False))
    return stages.withColumn(
        "state", F.when(F.col("running"), "live").when(F.col("progress") == 100, "done").when(doing, "doing").otherwise("other")
    )


def project_rollup(stages: DataFrame) -> DataFrame:
    done, total = F.sum("num_done"), F.sum("num_todos")
    return stages.groupBy("machine", "project_key").agg(
        F.first("project").alias("project"),
        total.alias("num_todos"), done.alias("num_done"), percent(done, total).alias("progress"),
        F.count("*").alias("num_stages"), count_if(F.col("running")).alias("num_active"),
        count_if(F.col("progress") == 100).alias("num_done_stages"),
        F.max("latest_at").alias("latest_at"), F.min("started_at").alias("started_at"),
        F.bool_or("foreground").alias("foreground"),
    )


def overall_counts(projects: DataFrame) -> DataFrame:
    return projects.agg(
        F.count("*").alias("projects"), count_if(F.col("num_active") > 0).alias("active_projects"),
        F.coalesce(F.sum("num_stages"), F.lit(0)).alias("stages"),
    )


def _hidden(c: str = "hidden") -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def shown_stages(projects: DataFrame, stages: DataFrame) -> DataFrame:
    """Stages with their project's hidden flag beside their own."""
    flags = projects.select("project_key", _hidden().alias("project_hidden"))
    return stages.withColumn("hidden", _hidden()).join(flags, "project_key")


def machine_rollup(projects: DataFrame, stages: DataFrame) -> DataFrame:
    """Live sessions, latest activity and the done meter per machine, busiest first."""
    visible = projects.filter(~_hidden())
    mine = shown_stages(projects, stages).filter(~F.col("project_hidden"))
    per = mine.groupBy("machine").agg(
        count_if(F.col("running") & ~F.col("hidden")).alias("live"),
        F.sum("num_done").alias("num_done"), F.sum("num_todos").alias("num_todos"),
    )
    own = visible.groupBy("machine").agg(F.count("*").alias("projects"), F.max("latest_at").alias("latest_at"))
    return own.join(per, "machine", "left").fillna(0, ["live", "num_done", "num_todos"]).withColumn(
        "progress_pct", F.when(F.col("num_todos") > 0, F.col("num_done") * 100.0 / F.col("num_todos"))
    ).orderBy(F.desc("live"), F.desc_nulls_last("latest_at"), "machine")


def headline_kpis(projects: DataFrame, stages: DataFrame) -> DataFrame:
    visible = projects.filter(~_hidden())
    seen = shown_stages(projects, stages).filter(~F.col("project_hidden") & ~F.col("hidden"))
    done, total = F.coalesce(F.sum("num_done"), F.lit(0)), F.coalesce(F.sum("num_todos"), F.lit(0))
    shown = seen.agg(
        F.when(total > 0, done * 100.0 / total).alias("overall_pct"), done.alias("num_done"), total.alias("num_todos"),
        count_if(F.col("running")).alias("live"), F.count("*").alias("stages"),
    )
    counts = visible.agg(F.struct(F.count("*").alias("p"), F.count_distinct("machine").alias("m")).alias("c"))
    return shown.withColumn("c", counts.scalar()).select(
        "overall_pct", "num_done", "num_todos", F.col("c.p").alias("projects"), "live", "stages", F.col("c.m").alias("machines")
    )


def tab_counts(projects: DataFrame, stages: DataFrame, subtasks: DataFrame) -> DataFrame:
    """Sessions per state tab; ``doing`` includes live; every hidden thing counts as hidden."""
    st = stage_state(shown_stages(projects, stages))
    seen = ~F.col("project_hidden") & ~F.col("hidden")
    tabs = st.agg(
        count_if(seen).alias("all"), count_if(seen & (F.col("state") == "live")).alias("live"),
        count_if(seen & F.col("state").isin("live", "doing")).alias("doing"),
        count_if(seen & (F.col("state") == "done")).alias("done"), count_if(F.col("hidden")).alias("hidden_stages"),
    )
    open_stages = st.filter(seen).select(*STAGE)
    hidden_todos = subtasks.filter(_hidden()).join(open_stages, STAGE, "left_semi").agg(F.count("*")).scalar()
    hidden_projects = projects.filter(_hidden()).agg(F.count("*")).scalar()
    return tabs.select("all", "live", "doing", "done", (F.col("hidden_stages") + hidden_projects + hidden_todos).alias("hidden"))


def progress_view(
    projects: DataFrame, stages: DataFrame, subtasks: DataFrame, state: str = "all", query: str = "", machine: str | None = None
) -> DataFrame:
    """Stages in view: hidden gate, state tab, machine, text search in title, to-dos and project."""
    todos = subtasks.groupBy(*STAGE).agg(
        F.bool_or(_hidden()).alias("todo_hidden"),
        F.bool_or(F.contains(F.lower("text"), F.lit(query.lower()))).alias("todo_match"),
    )
    names = projects.select("project_key", F.col("project").alias("project_name"))
    st = stage_state(shown_stages(projects, stages)).join(names, "project_key").join(todos, STAGE, "left").fillna(
        False, ["todo_hidden", "todo_match"]
    )
    if state == "hidden":
        st = st.filter(F.col("project_hidden") | F.col("hidden") | F.col("todo_hidden"))
    else:
        st = st.filter(~F.col("project_hidden") & ~F.col("hidden"))
        wanted = {"live": ["live"], "doing": ["doing", "live"], "done": ["done"]}.get(state)
        st = st.filter(F.col("state").isin(*wanted)) if wanted else st
    if query:
        q = F.lit(query.lower())
        st = st.filter(F.contains(F.lower("title"), q) | F.contains(F.lower("project_name"), q) | F.col("todo_match"))
    return st.filter(F.col("machine") == machine) if machine else st


def active_sections(stages: DataFrame) -> DataFrame:
    """Projects with unfinished or running work, against done or idle ones."""
    busy = F.col("running") | F.coalesce(F.col("progress") < 100, F.lit(False))
    return stages.groupBy("machine", "project_key").agg(F.bool_or(busy).alias("is_active"))


def live_now(projects: DataFrame, stages: DataFrame, subtasks: DataFrame) -> DataFrame:
    """Every running session, most recent first, with the to-do it is on: of two with one position the one of less ``place``, where that is given."""
    order = [c for c in ("pos", "place") if c in subtasks.columns]
    current = first_by(subtasks.filter("status = 'in_progress'").select(*STAGE, *order, "text"), STAGE, F.struct(*order))
    st = shown_stages(projects, stages).filter(F.col("running") & ~F.col("hidden") & ~F.col("project_hidden"))
    return st.join(current.select(*STAGE, F.col("text").alias("current_todo")), STAGE, "left").orderBy(
        F.desc_nulls_last("latest_at"), *STAGE
    )


def sort_stages(stages: DataFrame) -> DataFrame:
    return stages.orderBy(F.desc("foreground"), F.desc("running"), F.desc_nulls_last("latest_at"), *STAGE)


def sort_projects(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.desc("foreground"), F.desc("num_active"), F.desc_nulls_last("latest_at"), "project_key")


def summary_lines(projects: DataFrame, stages: DataFrame, title_chars: int | None = None) -> DataFrame:
    """Readable lines: each project, then its stages, in display order; titles are whole unless a length is given."""
    label = formats.percent(F.col("progress"))
    heads = projects.select(
        "project_key", F.col("foreground").alias("pf"), F.col("num_active").alias("pa"), F.col("latest_at").alias("pl"),
        F.lit(0).alias("level"), F.lit(False).alias("sf"), F.lit(False).alias("sr"), F.lit(None).cast("timestamp").alias("sl"),
        F.lit("").alias("stage_key"),
        F.format_string("%s: %s of %d stages, %d running", "project", label, "num_stages", "num_active").alias("line"),
    )
    order = projects.select("project_key", F.col("foreground").alias("pf"), F.col("num_active").alias("pa"), F.col("latest_at").alias("pl"))
    rows = stages.join(order, "project_key").select(
        "project_key", "pf", "pa", "pl", F.lit(1).alias("level"), F.col("foreground").alias("sf"), F.col("running").alias("sr"),
        F.col("latest_at").alias("sl"), F.col("stage_key").cast("string").alias("stage_key"),
        F.concat(
            F.format_string("  - %s: %s, %d of %d to-dos", F.col("title") if title_chars is None else F.substring("title", 1, title_chars), label, "num_done", "num_todos"),
            F.when(F.col("running"), ", running").otherwise(""), F.when(F.col("foreground"), ", in front").otherwise(""),
        ).alias("line"),
    )
    return heads.unionByName(rows).orderBy(
        F.desc("pf"), F.desc("pa"), F.desc_nulls_last("pl"), "project_key", "level", F.desc("sf"), F.desc("sr"), F.desc_nulls_last("sl"), "stage_key"
    ).select("line")


# --- user edits ---------------------------------------------------------------


def current_overlay(log: DataFrame, title_chars: int | None = None) -> DataFrame:
    """Edit log to current edits: valid rows only, last write per level, key and field wins; titles whole or cut."""
    title = F.col("value") if title_chars is None else F.substring("value", 1, title_chars)
    valid = (
        F.col("level").isin(*fixed.OVERLAY_LEVELS) & F.col("field").isin(*fixed.OVERLAY_FIELDS) & (F.col("key") != "")
        & ((F.col("field") == "hidden") | (F.length("value") > 0))
    )
    last = log.filter(valid).groupBy("level", "key", "field").agg(
        F.max_by(F.when(F.col("field") == "title", title).otherwise(F.col("value")), "at").alias("value")
    )
    return last.groupBy("level", "key").agg(
        F.max(F.when(F.col("field") == "title", F.col("value"))).alias("new_title"),
        F.max(F.when(F.col("field") == "hidden", F.lower("value") == "true")).alias("new_hidden"),
    )


def apply_overlay(df: DataFrame, overlay: DataFrame, level: str) -> DataFrame:
    """Replace the title when one was given, and the hidden flag when one was set."""
    key, title = {"project": ("project_key", "project"), "stage": ("stage_key", "title"), "subtask": ("subtask_key", "text")}[level]
    edits = overlay.filter(F.col("level") == level).select(F.col("key").alias(key), "new_title", "new_hidden")
    old = F.col("hidden") if "hidden" in df.columns else F.lit(False)
    return (
        df.join(edits, key, "left")
        .withColumns({title: F.coalesce(F.nullif("new_title", F.lit("")), title), "hidden": F.coalesce("new_hidden", old, F.lit(False))})
        .drop("new_title", "new_hidden")
    )
