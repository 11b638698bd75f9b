import json
import os

from tests.transcript_log import Log, tool, use
from pyspark.sql import functions as F

from turnwise.operators.records import read_records
from turnwise.streaming import feeds, fold


def sample():
    log = Log("s1", "/s/1").human("start here").call("m1", use(cr=10, out=5)).call("m1", use(cr=10, out=5)).at(4).human("no, other way")
    log.steer().at(5).human("[Request interrupted by user]").call("m2", use(out=2)).at(60).human("fine").call("m1", use(cr=10, out=5)).call(None, use(out=1))
    return log


def ship(folder, rows, name, size=None):
    """Write rows as chunk files of one transcript each."""
    folder.mkdir(parents=True, exist_ok=True)
    for k, start in enumerate(range(0, len(rows), size or len(rows))):
        part = rows[start : start + (size or len(rows))]
        file = folder / f"{name}-{k:04d}.json"
        file.write_text(json.dumps({"path": part[0][0], "base_line_no": part[0][1], "lines": [v for _, _, v in part]}))
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))  # the source takes the oldest file first


def drain(df, tmp_path, mode, name):
    """Run the stream over what is there; results go to a folder, so a later call resumes."""
    out = str(tmp_path / f"out-{name}")
    q = (
        df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}"))
        .foreachBatch(lambda batch, _id: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out))
        .trigger(availableNow=True).start()
    )
    done = q.awaitTermination(60)
    q.stop()
    assert done and q.exception() is None
    return df.sparkSession.read.parquet(out)


def test_chunks_carry_line_numbers(spark, tmp_path):
    rows = sample().rows
    ship(tmp_path / "in", rows, "c", 3)
    out = drain(feeds.stream_chunks(spark, str(tmp_path / "in")), tmp_path, "append", "chunks")
    assert sorted((r.line_no, r.value) for r in out.collect()) == [(n, v) for _, n, v in rows]


def test_fold_gives_the_batch_answer_at_every_cut(spark, tmp_path, session):
    rows = sample().rows
    want = session(sample())
    # Timers ask for another batch for ever; a run over what is there must not wait for them.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    for cut in (3, 7):
        folder = tmp_path / f"in{cut}"
        ship(folder, rows[:cut], "a")
        name = f"fold{cut}"
        # A second run resumes from the checkpoint with the later lines.
        for part in (None, rows[cut:]):
            if part:
                ship(folder, part, "b")
            out = drain(fold.stream_fold(read_records(feeds.stream_chunks(spark, str(folder)))), tmp_path, "update", name)
        got = out.orderBy(F.desc("next_line")).first()
        assert (got.human_turns, got.interrupts, got.steering, got.lex_corrections) == (want.human_turns, want.interrupts, want.steering, want.lex_corrections)
        assert got.first_correction_turn == want.first_correction_turn and round(got.active_seconds / 60, 1) == want.active_min
        u = want.by_model["big-1"]
        assert got.calls == u["calls"] and got.tokens == u["in"] + u["cr"] + u["out"] and not got.needs_recompute
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_dedupe_and_counters(spark, tmp_path):
    rows = sample().rows
    ship(tmp_path / "in", rows, "c", 4)
    recs = read_records(feeds.stream_chunks(spark, str(tmp_path / "in")))
    ids = drain(feeds.stream_dedupe(recs.filter("msg_id is not null").select("path", "msg_id"), ["path", "msg_id"]), tmp_path, "append", "ids")
    assert sorted(r.msg_id for r in ids.collect()) == ["m1", "m2"]
    r = drain(feeds.stream_counters(recs), tmp_path, "complete", "counts").orderBy(F.desc("records")).first()
    assert (r.human_turns, r.interrupts, r.steering, r.records) == (3, 1, 1, len(rows))


def test_bursts_and_closed_sessions_need_a_later_event(spark, tmp_path):
    log = Log("s1", "/s/1").human("a").at(5).human("b").at(16).human("c").at(900).human("sentinel")
    ship(tmp_path / "in", log.rows, "c", 1)
    recs = read_records(feeds.stream_chunks(spark, str(tmp_path / "in"), max_files=1)).select("path", "ts")
    bursts = drain(feeds.stream_bursts(recs, ["path"], "ts"), tmp_path, "append", "bursts")
    assert [(r.n, r.seconds) for r in bursts.orderBy("start").collect()] == [(2, 300.0), (1, 0.0)]
    closed = drain(feeds.closed_sessions(recs, ["path"], "ts"), tmp_path, "append", "closed")
    assert [r.n for r in closed.collect()] == [3]


def test_publisher_writes_once_for_equal_batches(spark, tmp_path):
    df = spark.createDataFrame([("m1", 1)], "machine string, n int")
    p = feeds.Publisher(str(tmp_path / "out"))
    p(df, 0)
    first = p.last
    p(df, 1)
    assert p.last is first


class Kept:
    """Stands in for a value or map state and its handle."""

    def __init__(self):
        self.value, self.map, self.timers, self.states = None, {}, [], {}

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        return key in self.map

    def updateValue(self, key, value):
        self.map[key] = value

    def clear(self):
        self.value, self.map = None, {}

    def getValueState(self, name, *schema):
        return self.states.setdefault(name, Kept())

    getMapState = getValueState

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, timer):
        self.timers.remove(timer)

    def registerTimer(self, timer):
        self.timers.append(timer)

    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_an_idle_session_keeps_its_totals_and_asks_for_a_rebuild(spark, lines, session):
    rows = fold.fold_input(read_records(lines(sample()))).toPandas().sort_values("line_no")
    handle, processor = Kept(), fold.SessionFold(idle_hours=1)
    processor.init(handle)
    run = lambda part: next(processor.handleInputRows(("/s/1",), iter([part]), handle)).iloc[0]
    before = run(rows.iloc[:7])
    assert handle.timers == [1000 + 3_600_000] and before.human_turns > 0 and not before.needs_recompute
    expired = next(processor.handleExpiredTimer(("/s/1",), handle, None)).iloc[0]
    assert expired.human_turns == before.human_turns and not handle.states["ids"].map
    after = run(rows.iloc[7:])
    assert after.needs_recompute and after.human_turns == before.human_turns
    folded = spark.createDataFrame([("/s/1", True), ("/other", False)], "path string, needs_recompute boolean")
    built, want = feeds.rebuild(folded, lines(sample(), Log("s2", "/other").human("x"))).collect(), session(sample())
    assert [(r.path, r.human_turns, r.active_min) for r in built] == [("/s/1", want.human_turns, want.active_min)]


def test_without_an_idle_time_no_timer_is_set(lines):
    handle, processor = Kept(), fold.SessionFold()
    processor.init(handle)
    next(processor.handleInputRows(("/s/1",), iter([fold.fold_input(read_records(lines(sample()))).toPandas()]), handle))
    assert handle.timers == []


def test_continued_sessions_are_closed_at_once(records):
    log = Log("s1", "/s/1").human("x").add(type="continued-in", continuedInSessionId="next")
    assert [tuple(r) for r in feeds.continued_sessions(records(log)).collect()] == [("/s/1", "next")]
