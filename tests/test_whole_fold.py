"""The streaming fold gives what the batch assembly gives, however the records arrive."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.transcript_log import Log, tool, use
from turnwise.operators.sessions import build_sessions
from turnwise.session import materialize
from turnwise.streaming import tail, whole_fold as W

WORDS = "the quick brown fox jumps over the lazy dog near the old river bank while many birds sing loudly today"


class State:
    """Stands in for value, map and list state, and for their handle."""

    def __init__(self):
        self.value, self.map, self.list, self.timers, self.states = None, {}, [], [], {}

    def getValueState(self, name, *schema):
        return self.states.setdefault(name, State())

    getMapState = getListState = getValueState

    def exists(self):
        return self.value is not None or bool(self.map) or bool(self.list)

    def get(self):
        return iter(self.list) if self.list else self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        del self.map[key]

    def keys(self):
        return iter(list(self.map))

    def appendList(self, values):
        self.list.extend(values)

    def clear(self):
        self.value, self.map, self.list = None, {}, []

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, timer):
        self.timers.remove(timer)

    def registerTimer(self, timer):
        self.timers.append(timer)

    def getCurrentProcessingTimeInMs(self):
        return 1000


def busy():
    """Everything a session row speaks of."""
    log = Log("s1", "/s/1").human(f"fix src/app.py only, done when tests pass. {WORDS}", gitBranch="main")
    log.call("m1", use(cr=100, out=5, inp=3), [tool("Bash", "t1", command="pytest -q"), tool("Edit", "t2")], effort="high").call("m1", use(cr=100, out=5), effort="high")
    log.result("t1", "2 passed").result("t2", "no such file", error=True).result("t1", "again").result("gone", "x")
    log.at(3).human("no, that is wrong").call("m2", use(cr=500, out=1, c5=7, speed="fast"), [tool("AskUserQuestion", "t3"), tool("Skill", "t4", skill="deploy")], model="small-haiku")
    log.compact(900, 100).compact(900, 100).steer().at(5).human(f"as I said: {WORDS}").call("m3", use(cr=90, out=2), [tool("Bash", "t5", command="git commit -m x")])
    log.result("t5", "ok").at(6).human("[Request interrupted by user for tool use]").human("carry on").call(None, use(out=1, inp=4), permissionMode="plan").call(None, None)
    log.add(type="user", toolDenialKind="user-rejected", message={"content": [{"type": "tool_result", "tool_use_id": "t3", "content": "denied"}]})
    log.at(70).compact(800, 300).add(type="pr-link", prNumber=12).add(type="pr-link", prNumber=7).add(type="pr-link", prNumber=12)
    log.raw('{"type":"user", broken').add(type="summary", other=1).add(type="assistant", attributionSkill="review", message={"model": "big-1", "content": "plain"})
    log.at(71).human(f"once more {WORDS}", cwd="/work/other").add(type="continued-in", continuedInSessionId="s2").call("m1", use(cr=1)).call("m4", use(cr=700, think=3), [tool("ExitPlanMode", "t6")])
    return log


def batch_row(spark, lines, log):
    rows = build_sessions(materialize(W.R.read_records(lines(log)), "whole"), publish_excerpt=True).collect()
    return rows[0].asDict(recursive=True)


@pytest.fixture
def fed(spark):
    """Narrow rows of a log, in order, with the position after each line."""

    def make(log, generation=0):
        lines = spark.createDataFrame([(p, generation, n, None, v) for p, n, v in log.rows], "path string, generation bigint, line_no bigint, upto bigint, value string")
        return W.fold_rows(W.covered_records(lines)).toPandas().sort_values("line_no")

    return make


def ranges(rows, cuts):
    """The rows with a covering row for each range between cuts."""
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        part = rows[(rows["line_no"] >= low) & (rows["line_no"] < high)]
        mark = pd.DataFrame([{"path": "/s/1", "generation": rows["generation"].iloc[0], "line_no": low, "upto": high, "row": None}])
        yield pd.concat([part, mark], ignore_index=True)


class Run:
    def __init__(self, **how):
        self.handle, self.fold = State(), W.WholeFold(**how)
        self.fold.init(self.handle)
        self.last = None

    def batch(self, *frames):
        (self.last,) = self.fold.handleInputRows(("/s/1",), iter(frames), self.handle)
        return self.last.iloc[0]

    def expire(self):
        (self.last,) = self.fold.handleExpiredTimer(("/s/1",), self.handle, None)
        return self.last.iloc[0]


def same(spark, folded, want):
    rows = [{"path": r["path"], "generation": int(r["generation"]), "folded": r["folded"], "needs_recompute": bool(r["needs_recompute"])} for _, r in pd.concat(folded).iterrows()]
    found = W.session_rows(spark.createDataFrame(rows, W.OUTPUT), publish_excerpt=True).collect()
    assert len(found) == len(folded)
    for got in found:
        got = got.asDict(recursive=True)
        assert not got.pop("needs_recompute") and got.pop("generation") >= 0
        assert got == want


def test_every_column_equals_the_batch_at_every_cut(spark, lines, fed):
    log = busy()
    want, rows, n = batch_row(spark, lines, log), fed(log), len(log.rows)
    assert want["reexplain"] == 2 and want["cache_resets"] and want["compactions"] and want["tool_err"] == {"Edit": 1} and want["skills"] == ["deploy", "review"]
    results = []
    for cut in range(1, n):
        run = Run()
        for part in ranges(rows, [0, cut, n]):
            run.batch(part)
        results.append(run.last)
    same(spark, results, want)


@pytest.mark.parametrize("how", [{}, {"bucket": 4, "held_rows": 2}, {"bucket": 1, "held_rows": 0}])
def test_order_of_arrival_does_not_matter(spark, lines, fed, how):
    log, rng = busy(), random.Random(5)
    want, rows, n = batch_row(spark, lines, log), fed(log), len(log.rows)
    results = []
    for _ in range(12):
        cuts = sorted({0, n, *rng.sample(range(1, n), 9)})
        parts = [*ranges(rows, cuts)]
        parts += rng.sample(parts, 3)  # some come twice
        rng.shuffle(parts)
        run, at = Run(**how), 0
        while at < len(parts):
            step = rng.randrange(1, 4)
            run.batch(*(p.sample(frac=1, random_state=1) for p in parts[at : at + step]))
            at += step
        assert not run.handle.states["pending"].map
        results.append(run.last)
    same(spark, results, want)


def test_records_wait_for_the_gap_before_them(fed):
    rows, n = fed(busy()), len(busy().rows)
    first, second, third = ranges(rows, [0, 10, 20, n])
    run = Run(wait_minutes=5, idle_hours=1)
    turns = lambda r: json.loads(r["folded"])["human_turns"]
    start = turns(run.batch(first))
    assert run.handle.timers == [1000 + 3_600_000]
    assert turns(run.batch(third)) == start and run.handle.timers == [1000 + 300_000]
    late = run.expire()
    assert turns(late) > start and late["needs_recompute"] and not run.handle.states["pending"].map
    assert run.batch(second)["needs_recompute"]


def test_a_new_generation_starts_again(spark, lines, fed):
    old, log = Log("s0", "/s/1").human("old").call("m1", use(cr=5)), busy()
    run = Run()
    run.batch(*ranges(fed(old), [0, 2]))
    first, second = ranges(fed(log, 1), [0, 15, len(log.rows)])
    run.batch(first, *ranges(fed(old), [0, 2]))
    run.batch(second)
    same(spark, [run.last], batch_row(spark, lines, log))


def test_an_idle_session_is_settled_and_asks_for_a_recompute(fed):
    first, second = ranges(fed(busy()), [0, 20, len(busy().rows)])
    run = Run(idle_hours=1)
    before = run.batch(first)
    after = run.expire()
    assert after["folded"] == before["folded"] and not run.handle.states["ids"].map and not run.handle.states["runs"].map
    late = run.batch(second)
    assert late["needs_recompute"] and late["folded"] == before["folded"]


def test_rows_are_held_within_bounds(spark, fed):
    """Ranges in reverse order: what waits lies in state, in buckets, and is folded bucket by bucket."""
    log = Log("s1", "/s/1")
    for i in range(400):
        log.human(f"message {i}")
    rows, run, most = fed(log), Run(bucket=50, held_rows=20), []
    fold = run.fold._fold
    run.fold._fold = lambda s, part, start: (most.append(len(part)), fold(s, part, start))[1]
    row = run.batch(*reversed([*ranges(rows, [*range(0, 401, 10)])]))
    assert max(most) <= 50 and json.loads(row["folded"])["human_turns"] == 400


def test_stream_over_growing_files(spark, lines, tmp_path):
    """Source and fold together, cut into small ranges, equal the batch over the finished file."""
    log = busy()
    data = "".join(v + "\n" for _, _, v in log.rows).encode()
    (tmp_path / "in/p").mkdir(parents=True)
    file, out = tmp_path / "in/p/a.jsonl", str(tmp_path / "out")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for end in (len(data) // 3, len(data)):
        file.write_bytes(data[:end])
        source = tail.stream_lines(spark, str(tmp_path / "in"), "*/*.jsonl", str(tmp_path / "pos"), block_bytes=700)
        q = W.stream_sessions(source).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(
            lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    last = spark.read.parquet(out).orderBy(F.desc("batch")).limit(1).toPandas()
    want = batch_row(spark, lines, log)
    same(spark, [last], want | {"path": last["path"].iloc[0]})
