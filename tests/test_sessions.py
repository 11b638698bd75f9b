"""Session signals.  Every scenario yields its transcripts and gets the finished rows back;
all transcripts are assembled in one run, as one table."""

import pytest
from tests.transcript_log import Log, tool, use
from pyspark.sql import functions as F

from turnwise.operators import sessions as S
from turnwise.operators.records import read_records
from turnwise.session import materialize

SCENARIOS = {}


def scenario(fn):
    SCENARIOS[fn.__name__] = fn
    return fn


@scenario
def usage_is_counted_once_per_message_however_late_it_returns():
    log = Log().human("start")
    for _ in range(3):
        log.call("m1", use(cr=10, out=5), [tool("Read", "t0")])
    for k in range(50):
        log.call(f"n{k}", use(out=1))
    log.call("m1", use(cr=10, out=5)).call(None, use(out=2)).call(None, use(out=2))
    s = yield log
    assert s.by_model["big-1"]["calls"] == 53 and s.by_model["big-1"]["out"] == 5 + 50 + 4
    assert s.tool_calls_total == 3 and s.tools == {"Read": 3}


@scenario
def first_record_of_an_id_wins_even_without_usage():
    s = yield Log().human("x").call("m").call("m", use(out=9))
    assert s.by_model is None


@scenario
def cache_reset_peak_and_final():
    log = Log().human("x")
    for i, cr in enumerate((100000, 110000, 2000)):
        log.call(f"m{i}", use(cr=cr), model=f"model-{i}")
    s = yield log
    assert (s.cache_resets, s.ctx_peak, s.ctx_final, s.peak_model) == (1, 110000, 2000, "model-1")


@scenario
def hard_signals_and_first_correction():
    log = Log().steer().human("one").human("two").human("[Request interrupted by user for tool use]")
    log.result("a", "no", toolDenialKind="user-rejected").result("b", "x", toolDenialKind="hook")
    s = yield log
    assert (s.steering, s.interrupts, s.interrupts_tool, s.denied_user, s.denied_auto, s.human_turns) == (1, 1, 1, 1, 1, 2)
    assert s.first_correction_turn == 1


@scenario
def automatic_denials_are_not_corrections():
    s = yield Log().human("one").result("b", "x", toolDenialKind="hook")
    assert s.denied_auto == 1 and s.first_correction_turn is None


@scenario
def lexicon_needs_a_follow_up_and_honours_exclusions():
    log = Log().human("no, start over").human("No worries, fine").human("noé").human("  Actually use the other one").human("nothing")
    s = yield log
    assert s.lex_corrections == 1 and s.first_correction_turn == 4


@scenario
def repeated_wording():
    text = "please rename the function in the parser module now"
    s = yield Log().human(text).human("something else entirely that is new and long enough").human("again: " + text).human("short one")
    assert s.reexplain == 1


@scenario
def compaction_retries_and_window():
    log = Log().human("t0").compact(900, 10).compact(900, 10)
    for k in range(7):
        log.human(f"turn {k} words that differ {k}")
    log.compact(800, 20, "manual").human("[Request interrupted by user]").human("last")
    s = yield log
    assert [(c.trigger, c.pre, c.turn_index) for c in s.compactions] == [("auto", 900, 1), ("manual", 800, 8)]
    assert s.turns_after_compaction == 5 + 1 and s.interrupts_after_compaction == 1


@scenario
def null_boundaries_compare_equal():
    log = Log().human("x").add(type="system", subtype="compact_boundary", compactMetadata={})
    s = yield log.add(type="system", subtype="compact_boundary")
    assert len(s.compactions) == 1


@scenario
def tools_results_and_outcomes():
    log = Log().human("x").call("m", None, [tool("Bash", "t1", command="python -m pytest -q"), tool("Bash", "t2", command="git  commit -m x"), tool("Edit", "t3")])
    log.result("t1", "ok").result("t2", "bad", True).result("t3", "abc").result("t3", "again").result("zz", "??")
    s = yield log
    assert (s.tests_run, s.git_commits) == (1, 0)
    assert s.tool_bytes == {"Bash": 5, "Edit": 3, "unknown": 7} and s.tool_err == {"Bash": 1}
    assert s.first_edit_turn == 1


@scenario
def asking_planning_skills_and_pull_requests():
    log = Log().human("x", permissionMode="plan").call("a", None, [tool("Skill", "k", skill="beta")], attributionSkill="alpha", effort="high")
    log.call("b", None, [tool("AskUserQuestion", "q")], attributionSkill="alpha", effort="high")
    log.add(type="pr-link", prNumber=7).add(type="pr-link", prNumber=3).add(type="pr-link", prNumber=7)
    log.add(type="continued-in", continuedInSessionId="next")
    s = yield log
    assert s.plan_mode and s.askuser == 1 and s.first_ask_turn == 1
    assert s.skills == ["alpha", "beta"] and s.effort == {"high": 2} and s.pr_numbers == [7, 3] and s.continued_in == "next"


@scenario
def active_time_skips_long_pauses_and_series_keeps_the_peak():
    pauses = Log().human("x").at(5).human("y").at(305).human("z")
    log = Log().human("x")
    for i in range(200):
        log.at(i).call(f"m{i}", use(inp=10 + i if i != 57 else 9999))
    s, t = yield pauses, log
    assert s.active_min == 5.0 and s.wall_min == 305.0 and s.turn_min == [0.0, 5.0, 305.0]
    series = t.ctx_series
    assert len(series) == 32 and max(p.ctx for p in series) == 9999
    assert (series[0]["min"], series[-1]["min"]) == (0.0, 199.0) and series == sorted(series, key=lambda p: p["min"])


@scenario
def opening_features_kind_and_excerpt():
    log = Log().human("In src/app.py do not touch tests. Should the plan pass?  key sk-ant-abcdefghijklmnop")
    r, s = yield Log().human("/judge-sessions now").human("more"), log
    assert r.kind == "judge" and r.slash_cmd
    assert s.has_path and s.has_constraint and s.has_done_criterion and s.mentions_plan and not s.is_question
    assert "sk-ant" not in s.fp_excerpt and "«redacted»" in s.fp_excerpt


@scenario
def excerpt_is_cut_last():
    spaced, key = yield Log().human("go" + " " * 700 + "fix the parser"), Log().human("x" * 190 + " sk-ant-" + "a" * 40)
    assert spaced.fp_excerpt == "go fix the parser" and key.fp_excerpt == "x" * 190 + " «redacted"


@scenario
def commands_are_read_to_their_end():
    s = yield Log().human("x").call("m", None, [tool("Bash", "t", command="echo " + "a" * 500 + " && pytest -q")]).result("t", "ok")
    assert s.tests_run == 1


@scenario
def two_files_with_one_session_id_are_two_sessions():
    a, b = yield Log("same").human("x"), Log("same").human("y")
    assert a.sid == b.sid and a.path != b.path


@pytest.fixture(scope="module")
def assembled(spark):
    running, rows = {}, []
    for name, fn in SCENARIOS.items():
        gen = fn()
        logs = next(gen)
        logs = logs if isinstance(logs, tuple) else (logs,)
        for i, log in enumerate(logs):
            rows += [(f"/{name}/{i}", n, v) for _, n, v in log.rows]
        running[name] = (gen, len(logs))
    lines = spark.createDataFrame(rows, "path string, line_no bigint, value string")
    records = materialize(read_records(lines), "t")
    done = {r.path: r for r in S.build_sessions(records, publish_excerpt=True, series_points=32).collect()}
    return running, done


@pytest.mark.parametrize("name", list(SCENARIOS) or ["none"])
def test_scenario(name, assembled):
    running, done = assembled
    gen, n = running[name]
    got = [done[f"/{name}/{i}"] for i in range(n)]
    with pytest.raises(StopIteration):
        gen.send(got[0] if n == 1 else got)


def test_subagents_roll_up_once(spark, records):
    files = spark.createDataFrame([("/s/1", "p", "explore"), ("/s/2", "p", None)], "path string, parent_sid string, agent_type string")
    a = Log("x", "/s/1").call("m", use(out=5), [tool("Read", "a")]).call("m", use(out=5), [tool("Read", "b")])
    b = Log("x", "/s/2").call("m", use(out=2))
    r = S.rollup_subagents(S.subagent_totals(files, records(a, b))).first()
    assert r.n == 2 and r.by_type == {"explore": 1, "unknown": 1} and r.tool_calls == 2 and r.by_model["big-1"]["out"] == 7


def test_resume_link_takes_the_last_predecessor(spark):
    df = spark.createDataFrame(
        [("/a", "s1", "s3"), ("/b", "s2", "s3"), ("/c", "s3", None), ("/d", "s4", "gone")], "path string, sid string, continued_in string"
    )
    got = {r.sid: r.resumed_from for r in S.link_resumes(df).collect()}
    assert got == {"s1": None, "s2": None, "s3": "s2", "s4": None}


def test_empty_input(spark):
    empty = spark.createDataFrame([], "path string, line_no bigint, value string")
    assert S.build_sessions(read_records(empty)).count() == 0


def test_placing_reads_its_input_twice_and_sorts_no_aggregate(records):
    written = materialize(records(Log().human("x").at(1).human("no, y")), "t")
    plan = S.turn_state(written)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 2 and "SortAggregate" not in plan


def test_assembly_reads_records_once_and_joins_few_parts(spark, records, monkeypatch):
    written = materialize(records(Log().human("x").call("m", use(out=3), [tool("Read", "a")])), "t")
    source, plans = set(written.inputFiles()), []

    def noted(df, name):
        plans.append(df)
        return materialize(df, name)

    monkeypatch.setattr(S, "materialize", noted)
    last = S.build_sessions(written)
    assert [bool(source & set(df.inputFiles())) for df in plans] == [True] + [False] * (len(plans) - 1)
    assert not source & set(last.inputFiles())
    assert plans[0]._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert last._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") <= 9


def test_feed_window_and_lifetime(records):
    s = materialize(S.build_sessions(materialize(records(Log().human("x").call("m", use(out=3))), "t")), "s")
    now = F.lit("2027-06-01").cast("timestamp")
    assert S.recent(s, now, 365).count() == 0 and S.recent(s, now).count() == 1 and S.lifetime_totals(s).first().out == 3
    assert S.review_cost(s).first().judge_tokens == 0
