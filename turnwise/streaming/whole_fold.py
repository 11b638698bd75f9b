"""Finished session rows kept up to date by a stream: all that ``build_sessions`` computes, record by record.

Text work (patterns, word runs, command classes, the parse itself) stays in the columns of the input; the fold sees narrow rows and does
what depends on order.  Scalars and per-model or per-tool counters are one value of state; message ids, word runs and open tool calls are keyed
maps, read one by one; the lists of a row (turn minutes, compactions, context points) are appended to.

**Order of arrival does not matter.**  A source that cuts files into ranges sends, for each, a row that says which lines it covers
(:mod:`turnwise.streaming.tail`).  Records are folded up to where the covered ranges reach without a gap, the rest waits, in state.  A
range that comes twice is folded once.  If a gap stays open for ``wait_minutes``, what waits is folded without it, and the session is reported for
a recompute from its files.

**Memory.**  Rows are taken batch by batch.  Beyond ``HELD_ROWS`` they go to state in buckets of ``BUCKET`` positions and are read back bucket by
bucket, so a task holds one bucket of one session, however much of a session a micro-batch brings and in whatever order.

**Idle sessions.**  ``idle_hours`` after the last record the maps are dropped and the totals stay.  A session that changes after that is reported
for a recompute.  A file that starts again (a new generation) begins with empty state.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnwise import fixed, schemas
from turnwise.functions import text as X
from turnwise.operators import records as R
from turnwise.operators.sessions import opening_columns, tool_count
from turnwise.streaming.fold import STATE_PROVIDER

HELD_ROWS = 50_000
REMEMBERED = 50_000
BUCKET = 1 << 20

_USED = ("in", "cc5", "cc1h", "cr", "out", "think")
_TEXTS = ("sid", "cwd", "git_branch", "entrypoint", "started_ts", "latest_ts", "continued_in", "opening", "peak_model")
_COUNTS = (
    "human_turns", "askuser", "tool_calls_total", "interrupts", "interrupts_tool", "denied_user", "denied_plan", "denied_auto", "steering", "lex_corrections",
    "turns_after_compaction", "interrupts_after_compaction", "reexplain", "reexplain_after_compaction", "cache_resets", "ctx_peak", "ctx_final", "tests_run", "git_commits",
)
_TURNS = ("first_ask_turn", "first_edit_turn", "first_correction_turn")

#: What the fold knows of a session; ``opening`` and ``peak_model`` become columns outside.
FOLDED = (
    ", ".join(f"{c} STRING" for c in _TEXTS) + ", latest_us BIGINT, " + ", ".join(f"{c} BIGINT" for c in (*_COUNTS, *_TURNS))
    + ", plan_mode BOOLEAN, active_min DOUBLE, wall_min DOUBLE, turn_min ARRAY<DOUBLE>"
    + f", compactions ARRAY<{schemas.COMPACTION}>, ctx_series ARRAY<STRUCT<min: DOUBLE, ctx: BIGINT>>, by_model MAP<STRING, {schemas.MODEL_USAGE}>"
    + ", tools MAP<STRING, BIGINT>, tool_err MAP<STRING, BIGINT>, tool_bytes MAP<STRING, BIGINT>, effort MAP<STRING, BIGINT>, skills ARRAY<STRING>, pr_numbers ARRAY<BIGINT>"
)
OUTPUT = "path STRING, generation BIGINT, folded STRING, needs_recompute BOOLEAN"


# ---------------------------------------------------------------- columns in

def covered_records(lines: DataFrame) -> DataFrame:
    """Records of a stream of lines with ``generation`` and ``upto``; rows of covered ranges stay."""
    return R.read_records(lines, carry=("generation", "upto"), unread=True)


def _tool_events(rtype: Column) -> Column:
    """Tool uses of an assistant's record and results of a user's, in order."""
    def event(b: Column) -> Column:
        use = b["btype"] == "tool_use"
        classes = X.command_class(F.when(b["tool_name"] == fixed.SHELL_TOOL, b["command"]))
        return F.struct(
            use.alias("use"), F.nullif(F.when(use, b["tool_id"]).otherwise(b["tool_use_id"]), F.lit("")).alias("id"), F.when(use, b["tool_name"]).alias("tool"),
            F.when(use, classes["is_test"]).alias("test"), F.when(use, classes["is_commit"]).alias("commit"), F.when(use, b["skill"]).alias("skill"),
            F.when(~use, b["result_chars"]).alias("size"), F.when(~use, b["is_error"]).alias("failed"),
        )

    kept = F.filter("blocks", lambda b: ((rtype == "assistant") & (b["btype"] == "tool_use")) | ((rtype == "user") & (b["btype"] == "tool_result")))
    return F.transform(kept, event)


def fold_rows(records: DataFrame) -> DataFrame:
    """(path, generation, line_no, upto, row): what the fold reads of a record, as narrow JSON without nulls."""
    rtype, u = F.col("rtype"), F.col("usage")
    assistant, human = rtype == "assistant", F.col("is_human")
    yes = lambda c: F.when(c, True)
    given = lambda c, when: F.when(when, F.col(c))
    events = _tool_events(rtype)
    has = lambda names: F.when(assistant, F.nullif(tool_count(names), F.lit(0)))
    row = F.struct(
        F.unix_micros("ts").alias("us"), F.col("ts_str").alias("ts"), F.col("sid"), F.col("cwd"), F.col("git_branch"), F.col("entrypoint"),
        yes(rtype == "continued-in").alias("continued"), given("continued_in", rtype == "continued-in").alias("continued_in"),
        yes(human).alias("human"), F.col("interrupt"), F.col("denial"), yes(F.col("is_steering")).alias("steering"),
        F.when(F.col("is_boundary"), F.col("compact")).alias("compact"), yes(assistant).alias("call"), given("msg_id", assistant).alias("id"), given("model", assistant).alias("model"),
        F.when(assistant, F.struct(*[u["in_tokens" if c == "in" else c].alias(c) for c in _USED], yes(u["fast"]).alias("fast"), yes(u.isNotNull()).alias("given"))).alias("usage"),
        F.when(assistant, F.nullif(R.call_context(u), F.lit(0))).alias("ctx"), given("effort", assistant).alias("effort"),
        yes(human & X.opens_like_correction(F.col("text"), F.lit(2))).alias("lex"), has(None).alias("n_tools"), has([fixed.ASK_TOOL]).alias("n_ask"), has(fixed.EDIT_TOOLS).alias("n_edit"),
        yes((F.col("permission_mode") == "plan") | F.coalesce(has(fixed.PLAN_TOOLS) > 0, F.lit(False))).alias("plans"),
        given("text", human).alias("text"), F.when(human, X.shingles(F.col("text"))).alias("runs"), F.when(F.size(events) > 0, events).alias("tools"),
        given("attribution_skill", assistant).alias("skill"), given("pr_number", rtype == "pr-link").alias("pr"),
    )
    return records.select("path", "generation", "line_no", "upto", F.when(F.col("upto").isNull(), F.to_json(row)).alias("row"))


# ---------------------------------------------------------------- the fold

def fresh(generation: int) -> dict:
    return {
        "generation": generation, "next": 0, "ranges": [], "seq": 0, "skipped": False, **dict.fromkeys(_COUNTS, 0), "plan_mode": False, "active": 0.0, "tool_use": {},
        "by_model": {}, "efforts": {}, "skill_list": [], "pr_list": [],
    }


def minutes(start: int | None, end: int | None) -> float:
    """As :func:`turnwise.functions.formats.minutes_between`: two places, zero where an end is missing."""
    if start is None or end is None:
        return 0.0
    return round((end - start) / 60_000_000.0 * 100) / 100


def _least(s: dict, name: str, turn: int) -> None:
    s[name] = turn if s.get(name) is None else min(s[name], turn)


class Keyed:
    """The state that is read key by key; every look costs a call to the JVM, so keys met before in a call of the operator are remembered,
    as many as ``REMEMBERED``, and list items are handed over together."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.ids = handle.getMapState("ids", "id STRING", "seen BOOLEAN")
        self.runs = handle.getMapState("runs", "run BIGINT", "seen BOOLEAN")
        self.open = handle.getMapState("open", "id STRING", "tool STRING, test BOOLEAN, commit BOOLEAN")
        self.items = handle.getListState("items", "kind STRING, item STRING")
        self.met: set = set()
        self.waiting: list[tuple[str, str]] = []

    def first_time(self, state, key) -> bool:
        if key in self.met:
            return False
        if len(self.met) < REMEMBERED:
            self.met.add(key)
        if state.containsKey((key,)):
            return False
        state.updateValue((key,), (True,))
        return True

    def add(self, kind: str, item) -> None:
        self.waiting.append((kind, json.dumps(item)))
        if len(self.waiting) >= REMEMBERED:
            self.settle()

    def settle(self) -> None:
        """Hand items over, and remember nothing beyond this call: the next one may be about another session."""
        if self.waiting:
            self.items.appendList(self.waiting)
        self.waiting, self.met = [], set()

    def forget(self) -> None:
        self.waiting, self.met = [], set()
        for state in (self.ids, self.runs, self.open):
            state.clear()


def feed(s: dict, r: dict, keyed: Keyed) -> None:
    """Add one record, the next in order, to a session."""
    _feed_meta(s, r)
    at_min = minutes(s.get("lo"), s.get("hi"))
    s["wall_min"] = max(s.get("wall_min", 0.0), at_min)
    human, before = bool(r.get("human")), s["human_turns"]
    s["human_turns"] += human
    turn = s["human_turns"]
    if "compact" in r:
        _feed_boundary(s, r["compact"], at_min, turn, keyed)
    since = None if s.get("window_at") is None else turn - s["window_at"]
    turn_in = since is not None and 1 <= since <= fixed.POST_BOUNDARY_TURNS
    if "interrupt" in r:
        s["interrupts"] += 1
        s["interrupts_tool"] += r["interrupt"] == "tool"
        s["interrupts_after_compaction"] += since is not None and since < fixed.POST_BOUNDARY_TURNS
    if "denial" in r:
        s[f"denied_{r['denial']}"] += 1
    s["steering"] += bool(r.get("steering"))
    lex = bool(r.get("lex")) and turn > 1
    s["lex_corrections"] += lex
    hard = r.get("steering") or "interrupt" in r or r.get("denial") in ("user", "plan")
    if hard or lex:
        _least(s, "first_correction_turn", max(1, before if hard else turn))
    s["tool_calls_total"] += r.get("n_tools", 0)
    s["askuser"] += r.get("n_ask", 0)
    for name, field in (("first_ask_turn", "n_ask"), ("first_edit_turn", "n_edit")):
        if r.get(field, 0) > 0:
            _least(s, name, max(1, turn))
    s["plan_mode"] |= bool(r.get("plans"))
    if human:
        s.setdefault("opening", r.get("text"))
        s["turns_after_compaction"] += turn_in
        keyed.add("turn", at_min)
        known = [not keyed.first_time(keyed.runs, run) for run in r.get("runs", ())]
        s["reexplain"] += any(known)
        s["reexplain_after_compaction"] += any(known) and turn_in
    if "skill" in r:
        _sight(s["skill_list"], r["skill"])
    if r.get("call"):
        _feed_call(s, r, at_min, keyed)
    for event in r.get("tools", ()):
        _feed_tool(s, event, keyed)
    if "pr" in r:
        _sight(s["pr_list"], r["pr"])


def _sight(seen: list, item) -> None:
    if item not in seen:
        seen.append(item)


def _feed_meta(s: dict, r: dict) -> None:
    if "sid" in r:
        s.setdefault("sid", r["sid"])
    for name in ("cwd", "git_branch", "entrypoint"):
        if name in r:
            s[name] = r[name]
    if r.get("continued"):
        s["continued_in"] = r.get("continued_in")
    us = r.get("us")
    if us is not None:
        if s.get("lo") is None or us < s["lo"]:
            s["lo"], s["started_ts"] = us, r.get("ts")
        if s.get("hi") is None or us > s["hi"]:
            s["hi"], s["latest_ts"] = us, r.get("ts")
    if "ts" in r:
        if us is not None and s.get("last") is not None:
            gap = (us - s["last"]) / 1e6
            s["active"] += gap if 0 < gap <= fixed.ACTIVE_GAP_SECONDS else 0.0
        s["last"] = us


def _feed_boundary(s: dict, c: dict, at_min: float, turn: int, keyed: Keyed) -> None:
    mark = [c.get("pre"), c.get("dropped")]
    if s.get("boundary") != mark:  # an equal one is the same boundary, written again
        s["window_at"] = turn
        keyed.add("compaction", {**{f: c.get(f) for f in ("trigger", "pre", "post", "dropped")}, "at_min": at_min, "turn_index": turn})
    s["boundary"] = mark


def _feed_call(s: dict, r: dict, at_min: float, keyed: Keyed) -> None:
    if "effort" in r:
        s["efforts"][r["effort"]] = s["efforts"].get(r["effort"], 0) + 1
    if "id" in r and not keyed.first_time(keyed.ids, r["id"]):
        return
    u = r.get("usage", {})
    if u.get("given"):
        held = s["by_model"].setdefault(r.get("model", "unknown"), dict.fromkeys(schemas.COUNTERS, 0))
        held["calls"] += 1
        held["fast_calls"] += bool(u.get("fast"))
        for name in _USED:
            held[name] += u.get(name, 0)
    ctx = r.get("ctx", 0)
    if ctx > 0:
        carried, earlier = u.get("cr", 0), s.get("carried")
        s["cache_resets"] += bool(earlier) and carried < earlier * fixed.RESET_RATIO
        s["carried"] = carried
        if ctx > s["ctx_peak"]:
            s["ctx_peak"], s["peak_model"] = ctx, r.get("model")
        s["ctx_final"] = ctx
        keyed.add("context", {"min": at_min, "ctx": ctx})


def _feed_tool(s: dict, e: dict, keyed: Keyed) -> None:
    held = lambda tool: s["tool_use"].setdefault(tool, [0, 0, 0, 0])  # noqa: E731  calls, errors, size, results
    tool_id = e.get("id")
    if e["use"]:
        held(e["tool"])[0] += 1
        if tool_id is not None:
            keyed.open.updateValue((tool_id,), (e["tool"], e["test"], e["commit"]))
        if e["tool"] == fixed.SKILL_TOOL and e.get("skill"):
            _sight(s["skill_list"], e["skill"])
        return
    tool, test, commit = None, False, False
    if tool_id is not None and keyed.open.containsKey((tool_id,)):
        tool, test, commit = keyed.open.getValue((tool_id,))
        keyed.open.removeKey((tool_id,))
    counts = held(tool or "unknown")
    counts[1] += e["failed"]
    counts[2] += e["size"]
    counts[3] += 1
    s["tests_run"] += bool(test and not e["failed"])
    s["git_commits"] += bool(commit and not e["failed"])


def finished(s: dict, items: Iterator[tuple[str, str]]) -> str:
    """The session's row as JSON."""
    lists = defaultdict(list)
    for kind, item in items:
        lists[kind].append(json.loads(item))
    tools = s["tool_use"]
    of = lambda i, kept: {t: c[i] for t, c in tools.items() if kept(c)} if tools else None
    active = Decimal(repr(s["active"] / 60.0)).quantize(Decimal("0.1"), ROUND_HALF_EVEN)
    return json.dumps({
        **{c: s.get(c) for c in (*_TEXTS, *_COUNTS, *_TURNS, "plan_mode")}, "latest_us": s.get("hi"), "active_min": float(active), "wall_min": s.get("wall_min"),
        "turn_min": lists["turn"], "compactions": lists["compaction"], "ctx_series": lists["context"], "by_model": s["by_model"] or None,
        "tools": of(0, lambda c: c[0] > 0), "tool_err": of(1, lambda c: c[1] > 0), "tool_bytes": of(2, lambda c: c[3] > 0), "effort": s["efforts"] or None,
        "skills": s["skill_list"], "pr_numbers": s["pr_list"],
    })


# ---------------------------------------------------------------- state

def cover(s: dict, low: int, high: int) -> None:
    """Note a range; the position up to which nothing is missing moves on where it can."""
    ranges = sorted([*map(tuple, s["ranges"]), (low, high)])
    merged: list[list[int]] = []
    for a, b in ranges:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    s["ranges"] = merged


class WholeFold(StatefulProcessor):
    def __init__(self, idle_hours: float | None = None, wait_minutes: float | None = None, bucket: int = BUCKET, held_rows: int = HELD_ROWS):
        self.idle_ms = None if idle_hours is None else int(idle_hours * 3_600_000)
        self.wait_ms = None if wait_minutes is None else int(wait_minutes * 60_000)
        self.bucket, self.held_rows = bucket, held_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "json STRING")
        self.pending = handle.getMapState("pending", "bucket BIGINT, seq BIGINT", "rows STRING")
        self.settled = handle.getValueState("settled", "yes BOOLEAN")
        self.keyed = Keyed(handle)

    # -- rows that wait

    def _put(self, s: dict, rows: list[tuple[int, str]]) -> None:
        by_bucket = defaultdict(list)
        for at, row in rows:
            by_bucket[at // self.bucket].append(f"{at} {row}")
        for bucket, lines in by_bucket.items():
            s["seq"] += 1
            self.pending.updateValue((bucket, s["seq"]), ("\n".join(lines),))

    def _advance(self, s: dict, held: list[tuple[int, str]]) -> None:
        """Fold what lies before the first gap, in order; the rest waits."""
        start = s["next"]
        while s["ranges"] and s["ranges"][0][0] <= s["next"]:
            s["next"] = max(s["next"], s["ranges"].pop(0)[1])
        waiting = sorted({tuple(k) for k in self.pending.keys()})
        if waiting:
            self._put(s, held)
            held, waiting = [], sorted({tuple(k) for k in self.pending.keys()})
        self._fold(s, held, start)
        by_bucket = defaultdict(list)
        for bucket, seq in waiting:
            by_bucket[bucket].append(seq)
        for bucket in sorted(by_bucket):
            if bucket * self.bucket >= s["next"]:
                break
            rows = []
            for seq in by_bucket[bucket]:
                rows += [(int(at), row) for at, _, row in (line.partition(" ") for line in self.pending.getValue((bucket, seq))[0].split("\n"))]
                self.pending.removeKey((bucket, seq))
            self._fold(s, rows, start)

    def _fold(self, s: dict, rows: list[tuple[int, str]], start: int) -> None:
        rows.sort()
        last, rest = None, []
        for at, row in rows:
            if at >= s["next"]:
                rest.append((at, row))
            elif at >= start and at != last:
                feed(s, json.loads(row), self.keyed)
                last = at
        if rest:
            self._put(s, rest)

    def _reset(self, generation: int) -> dict:
        for state in (self.totals, self.pending, self.settled, self.keyed.items):
            state.clear()
        self.keyed.forget()
        return fresh(generation)

    # -- Spark calls these

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s = json.loads(self.totals.get()[0]) if self.totals.exists() else fresh(0)
        settled, held = self.settled.exists(), []
        for frame in rows:
            for generation, part in frame.groupby("generation", sort=True):
                if generation > s["generation"]:
                    s, settled, held = self._reset(int(generation)), False, []
                elif generation < s["generation"]:
                    continue
                if settled:
                    continue
                marks = part[part["upto"].notna()]
                for low, high in zip(marks["line_no"], marks["upto"], strict=True):
                    cover(s, int(low), int(high))
                lines = part[part["upto"].isna()]
                held += zip(lines["line_no"].astype("int64").tolist(), lines["row"].tolist(), strict=True)
                if len(held) > self.held_rows:
                    self._put(s, held)
                    held = []
        if settled:
            yield self._row(key, s, True)
            return
        self._advance(s, held)
        self._timers(s, timerValues)
        yield self._row(key, s, s["skipped"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = json.loads(self.totals.get()[0]) if self.totals.exists() else fresh(0)
        if s["ranges"]:  # a gap that stayed open: go on behind it
            s["ranges"], s["skipped"] = [[s["next"], s["ranges"][-1][1]]], True
            self._advance(s, [])
            self._timers(s, timerValues)
        else:
            self.keyed.forget()
            self.settled.update((True,))
        yield self._row(key, s, s["skipped"])

    def _timers(self, s: dict, timerValues) -> None:
        delay = self.wait_ms if s["ranges"] and self.wait_ms is not None else self.idle_ms
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if delay is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + delay)

    def _row(self, key, s: dict, recompute: bool) -> pd.DataFrame:
        self.keyed.settle()
        self.totals.update((json.dumps(s),))
        return pd.DataFrame([{"path": key[0], "generation": s["generation"], "folded": finished(s, self.keyed.items.get() if self.keyed.items.exists() else ()), "needs_recompute": recompute}])

    def close(self) -> None:
        pass


# ---------------------------------------------------------------- on Spark

def session_rows(folded: DataFrame, publish_excerpt: bool = False) -> DataFrame:
    """The columns of ``build_sessions`` from the fold's output, with ``generation`` and ``needs_recompute``."""
    out = folded.select("path", "generation", "needs_recompute", F.from_json("folded", FOLDED).alias("f")).select("path", "generation", "needs_recompute", "f.*")
    out = out.withColumn("latest_at", F.timestamp_micros("latest_us")).withColumn("ctx_window", R.model_window(F.col("peak_model")))
    out = out.select("*", *opening_columns(F.col("opening"))).drop("opening", "latest_us").filter(F.col("sid").isNotNull())
    return out.withColumn("fp_excerpt", F.substring("fp_excerpt", 1, fixed.EXCERPT_CHARS)) if publish_excerpt else out.drop("fp_excerpt")


def stream_sessions(lines: DataFrame, idle_hours: float | None = None, wait_minutes: float | None = None, **bounds: int) -> DataFrame:
    """Folded rows (see :func:`session_rows`) of every session that a micro-batch touched; ``lines`` as from :func:`tail.stream_lines`.

    Timers make Spark plan batches without data.  A run that should end when the input is used up (``availableNow``) needs
    ``spark.sql.streaming.noDataMicroBatches.enabled=false``; timers that are due then fire with the next batch that has data.
    """
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    return fold_rows(covered_records(lines)).groupBy("path").transformWithStateInPandas(
        WholeFold(idle_hours, wait_minutes, **bounds), outputStructType=OUTPUT, outputMode="Update", timeMode="ProcessingTime"
    )
