"""Published tables change as one, and the streaming upkeep ends where the batch ends."""

import glob
import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.test_whole_fold import State, busy
from tests.transcript_log import Log, tool, use
from turnwise.operators.records import read_records
from turnwise.operators.sessions import build_sessions
from turnwise.plans import findings, metrics
from turnwise.session import materialize
from turnwise.sources import snapshots as S
from turnwise.streaming import tail, upkeep, whole_fold as W

NOW = datetime(2026, 1, 2)


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "feed")
    one = {"a": spark.createDataFrame([(1, "x")], "n int, generated_utc string"), "b": spark.createDataFrame([(2,)], "n int")}
    first = S.publish(one, root, "m1", NOW)
    # A publisher that dies between its tables leaves folders that no manifest names.
    S.write_part(spark.createDataFrame([(9, "y")], "n int, generated_utc string"), root, "m1", "a")
    assert S.current(spark, root, "m1") == first and S.read(spark, first, "a").first().n == 1
    two = S.publish({"a": one["a"].withColumn("n", F.lit(5)), "b": one["b"]}, root, "m1", NOW + timedelta(seconds=1))
    assert two.version == 2 and S.read(spark, two, "a").first().n == 5 and S.read(spark, first, "a").first().n == 1


def test_nothing_new_is_published_after_a_restart(spark, tmp_path):
    root = str(tmp_path / "feed")
    df = spark.createDataFrame([(1, "t1")], "n int, generated_utc string")
    first = S.publish({"a": df}, root, "m1", NOW, "run/0")
    assert S.publish({"a": df.withColumn("n", F.lit(7))}, root, "m1", NOW, "run/0") == first  # the same batch, replayed
    assert S.publish({"a": df.withColumn("generated_utc", F.lit("t2"))}, root, "m1", NOW + timedelta(seconds=60), "run/1") == first
    assert S.publish({"a": df}, root, "m1", NOW + timedelta(seconds=700), "run/2").version == 2


def test_a_table_that_became_empty_is_empty(spark, tmp_path):
    root = str(tmp_path / "feed")
    df = spark.createDataFrame([("m1", 1)], "machine string, n int")
    S.publish({"a": df}, root, "m1", NOW)
    other = S.publish({"a": df.withColumn("machine", F.lit("m2"))}, root, "m2", NOW)
    gone = S.publish({"a": df.where("n > 1")}, root, "m1", NOW)
    assert S.read(spark, gone, "a").count() == 0
    assert [r.machine for r in S.read(spark, S.owners(spark, root), "a").collect()] == ["m2"] and other.version == 1


def test_a_damaged_feed_is_left_out_whole(spark, tmp_path, records):
    sessions = build_sessions(materialize(records(Log("s1", "/a").human("one").call("m", use(out=5), [tool("Read", "t")])), "r"))
    out = str(tmp_path / "feeds")
    for machine in ("m1", "m2"):
        metrics.publish(metrics.build_feed(sessions, machine, NOW), out)
    assert findings.merged_feeds(spark, out).machines.count() == 2
    for file in glob.glob(f"{out}/m2/lifetime/*/*.parquet"):
        open(file, "wb").write(b"no parquet")
    merged = findings.merged_feeds(spark, out)
    assert [r.machine for r in merged.machines.collect()] == ["m1"] and merged.sessions.select("machine").distinct().count() == 1
    assert [r.machine for r in merged.skipped.collect()] == ["m2"]


def test_upsert_replaces_rows_by_key_and_leaves_other_buckets(spark, tmp_path):
    root = str(tmp_path / "t")
    state = S.current(spark, root, "m")
    rows = lambda xs: spark.createDataFrame(xs, "k string, n int")
    for batch in ([("a", 1), ("b", 1), ("c", 1)], [("b", 2)], [("d", 3)]):
        df = rows(batch)
        parts = S.upsert(df, root, state, "t", ["k"], buckets=4)
        kept = {b: p for b, p in state.parts.get("t", {}).items() if parts[b] == p}
        state = S.commit(spark, root, state, {"t": parts}, {"t": df.schema.json()})
    assert sorted(map(tuple, S.read(spark, state, "t").collect())) == [("a", 1), ("b", 2), ("c", 1), ("d", 3)]
    assert kept


def test_upkeep_ends_where_the_batch_ends(spark, lines, tmp_path):
    """One session goes on as the fold has it; another is reported for a recompute, and its row comes from its file."""
    (tmp_path / "in/p").mkdir(parents=True)
    busy_log, other = busy(), Log("s2", "/s/2").human("hello").call("m9", use(out=3), [tool("Read", "t")]).human("no, not that")
    files = {"a": busy_log, "b": other}
    for name, log in files.items():
        (tmp_path / f"in/p/{name}.jsonl").write_text("".join(v + "\n" for _, _, v in log.rows))
    whole = materialize(read_records(tail.read_paths(spark.createDataFrame([(f"file:{tmp_path}/in/p/{n}.jsonl",) for n in files], "path string"), str(tmp_path / "in"), block=500)), "whole")
    want = {r.path: r.asDict(recursive=True) for r in build_sessions(whole).collect()}
    assert len(want) == 2 and whole.count() > 30
    body = upkeep.Upkeep(str(tmp_path / "in"), str(tmp_path / "out"), "m1", buckets=4)
    marks = lambda path, recompute, rows: (path, 0, rows, recompute)
    a, b = sorted(want)
    folded = {}
    for path, log in ((a, busy_log), (b, other)):
        frame = spark.createDataFrame([(path, 0, n, None, v) for _, n, v in log.rows], "path string, generation bigint, line_no bigint, upto bigint, value string")
        s, keyed = W.fresh(0), W.Keyed(State())
        for row in W.fold_rows(W.covered_records(frame)).orderBy("line_no").collect():
            W.feed(s, json.loads(row.row), keyed)
        keyed.settle()
        folded[path] = W.finished(s, keyed.items.get() or ())
    body(spark.createDataFrame([marks(a, False, folded[a]), marks(b, False, folded[a])], W.OUTPUT), 0)
    body(spark.createDataFrame([marks(b, True, folded[a])], W.OUTPUT), 1)
    version = S.current(spark, str(tmp_path / "out"), "m1").version
    body(spark.createDataFrame([marks(b, False, folded[a])], W.OUTPUT), 1)  # a replay
    assert S.current(spark, str(tmp_path / "out"), "m1").version == version
    got = {r.path: r.asDict(recursive=True) for r in upkeep.sessions(spark, str(tmp_path / "out"), "m1").collect()}
    for row in got.values():
        row.pop("generation")
    assert got == want
