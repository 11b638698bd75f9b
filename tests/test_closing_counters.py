"""Closed sessions with both causes in either order; counters of what was read."""

import glob
import os

import pandas as pd
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tests.test_streaming import drain, ship
from tests.test_whole_fold import State, busy
from tests.transcript_log import Log
from turnwise.operators.records import read_records
from turnwise.streaming import closing, counters, feeds


def frame(*rows):
    return pd.DataFrame([{"path": "/s/1", "ts": None, "line_no": n, "us": us, "continued_in": to} for n, us, to in rows])


def in_turn(tmp_path):
    """The source takes the oldest file first."""
    for i, file in enumerate(sorted(glob.glob(str(tmp_path / "in/*.json")))):
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))


class Run:
    def __init__(self):
        self.handle, self.op = State(), closing.Closing(1)
        self.op.init(self.handle)

    def batch(self, *frames):
        return [tuple(r) for out in self.op.handleInputRows(("/s/1",), iter(frames), self.handle) for r in out.itertuples(index=False)]

    def expire(self):
        return [tuple(r) for out in self.op.handleExpiredTimer(("/s/1",), self.handle, None) for r in out.itertuples(index=False)]


def test_continued_then_idle():
    run = Run()
    assert run.batch(frame((0, 5_000_000, None))) == [] and run.handle.timers == [5000 + 3_600_000]
    assert run.batch(frame((2, 7_000_000, "b"), (1, 6_000_000, "a"))) == [("/s/1", "continued", "b", 7_000_000, 3)]
    assert run.handle.timers == [] and run.expire() == [] and run.batch(frame((3, 8_000_000, "c"))) == [] and run.handle.timers == []


def test_idle_then_continued():
    run = Run()
    run.batch(frame((0, 5_000_000, None)), frame((1, 9_000_000, None)))
    assert run.batch(frame((2, 6_000_000, None))) == [] and run.handle.timers == [9000 + 3_600_000]  # an older record does not bring it forward
    assert run.expire() == [("/s/1", "idle", None, 9_000_000, 3)]
    assert run.expire() == [] and run.batch(frame((3, 99_000_000, "x"))) == []


def test_records_without_a_time():
    run = Run()
    assert run.batch(frame((0, None, None))) == [] and run.handle.timers == []
    ((path, cause, target, latest, n),) = run.batch(frame((1, None, "b")))
    assert (path, cause, target, n) == ("/s/1", "continued", "b", 2) and pd.isna(latest)


def test_a_stream_closes_each_session_once(spark, tmp_path):
    idle = Log("s1", "/s/1").human("a").at(5).human("b")
    onward = Log("s2", "/s/2").human("a").add(type="continued-in", continuedInSessionId="s3").at(6).human("still here")
    late = Log("s3", "/s/3").at(900).human("moves the watermark").at(1000).human("on")
    for i, log in enumerate((idle, onward, late)):
        ship(tmp_path / "in", log.rows, f"c{i}", 1)
    in_turn(tmp_path)
    recs = read_records(feeds.stream_chunks(spark, str(tmp_path / "in"), max_files=1))
    got = drain(closing.stream_closed(recs, idle_hours=6), tmp_path, "update", "closing").collect()
    assert sorted((r.path, r.cause, r.continued_in) for r in got) == [("/s/1", "idle", None), ("/s/2", "continued", "s3")]


def test_counters_of_a_batch_are_taken_on_its_pass(spark, lines):
    log = busy()
    log.raw('{"type":"assistant", half').raw('{"no":"marker"}')
    counted, parsed = Observation("c"), Observation("p")
    n = counters.observed_records(lines(log), counted, parsed).count()
    whole = read_records(lines(log)).count()
    assert n == whole and counted.get == {"lines": len(log.rows)}
    assert parsed.get["records"] == whole and parsed.get["bad"] == 2 and parsed.get["relevant"] == whole + 2


def test_metrics_of_a_stream_become_rows(spark, tmp_path):
    old, new = Log("s1", "/s/1").human("early"), Log("s2", "/s/2").at(1300).human("late by far")
    broken = Log("s3", "/s/3").at(1290).human("x").raw('{"type":"user", broken').raw("nothing")
    for i, log in enumerate((new, broken, old)):
        ship(tmp_path / "in", log.rows, f"c{i}")
    in_turn(tmp_path)
    listener = counters.Metrics(spark, str(tmp_path / "metrics"))
    spark.streams.addListener(listener)
    try:
        recs = counters.observed_records(feeds.stream_chunks(spark, str(tmp_path / "in"), max_files=1))
        counts = recs.withWatermark("ts", "1 minute").groupBy(F.window("ts", "1 hour")).count()
        drain(counts, tmp_path, "update", "counted")
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    health = counters.ingest_health(counters.read_metrics(spark, str(tmp_path / "metrics"))).first()
    assert (health.lines, health.relevant, health.records, health.bad, health.late) == (5, 4, 3, 1, 1)
    assert health.bad_share == 0.25 and round(health.filtered_share, 6) == 0.2
