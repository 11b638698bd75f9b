import json
from datetime import datetime, timedelta

from tests.transcript_log import Log, tool, use
from pyspark.sql import functions as F

from turnwise.plans import findings, metrics, progress, reviewing
from turnwise.sources import sinks, tables, transcripts

NOW = datetime(2026, 1, 2)


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(v + "\n" for _, _, v in rows))


def test_line_numbers_follow_file_order_over_many_splits(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 300)):
        write(tmp_path / "proj" / f"{name}.jsonl", [(0, 0, json.dumps({"n": i, "pad": "x" * 40})) for i in range(n)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = transcripts.read_transcripts(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() >= 1
        rows = df.select(F.element_at(F.split("path", "/"), -1).alias("f"), "line_no", F.get_json_object("value", "$.n").cast("int").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 5300 and all(r.line_no == r.n for r in rows)


def test_missing_folders_give_empty_tables(spark, tmp_path):
    assert transcripts.read_transcripts(spark, str(tmp_path / "none")).count() == 0


def test_transcript_folder_to_findings(spark, tmp_path):
    root = tmp_path / "projects"
    for k in range(6):
        log = Log(f"s{k}").human("start").call(f"m{k}", use(out=5), [tool("Read", "t")]).result("t").human("[Request interrupted by user]")
        if k == 0:
            log.add(type="continued-in", continuedInSessionId="s1")
        write(root / "p" / f"s{k}.jsonl", log.rows)
    for k in range(6):
        log = Log(f"q{k}").human("in src/app.py do not touch tests").call(f"n{k}", use(out=5), [tool("Read", "t")]).human("thanks")
        write(root / "q" / f"q{k}.jsonl", log.rows)
    write(root / "p" / "s2" / "subagents" / "agent-1.jsonl", Log("s2").call("z", use(out=50), [tool("Read", "t")]).rows)
    write(root / "p" / "s2" / "subagents" / "workflows" / "w" / "agent-2.jsonl", Log("s2").call("z", use(out=7)).rows)
    (root / "p" / "s2" / "subagents" / "agent-1.meta.json").write_text(json.dumps({"agentType": "explore"}))
    sessions = metrics.session_tables(spark, str(root))
    rows = {r.sid: r for r in sessions.collect()}
    assert len(rows) == 12 and rows["s1"].resumed_from == "s0"
    assert rows["s2"].subagents.n == 2 and rows["s2"].subagents.by_type == {"explore": 1, "unknown": 1} and rows["s2"].subagents.by_model["big-1"]["out"] == 57
    out = str(tmp_path / "feeds")
    for name in ("m1", "m2"):
        metrics.publish(metrics.build_feed(sessions, name, NOW), out)
    metrics.publish(metrics.build_feed(sessions, "m2", NOW), out)
    merged = findings.merged_feeds(spark, out)
    assert merged.sessions.count() == 24 and merged.totals.first().lifetime_sessions == 24 and merged.machines.count() == 2
    ranked, locked, _ = findings.findings(merged.sessions, NOW, days=None)
    top = ranked.collect()
    assert top[0].rule_id == "first_prompt_anchors" and locked.count() == 9


def test_queue_and_ingest_plan(spark, tmp_path, records):
    from turnwise.operators import review
    from turnwise.operators.sessions import build_sessions
    from turnwise.session import materialize

    recs = materialize(records(Log("s1", "/a").human("one").human("two").human("three")), "r")
    sessions = materialize(build_sessions(recs), "s")
    prior = spark.createDataFrame([], "sid string, attempts bigint, n_turns bigint, at timestamp, has_result boolean")
    live = spark.createDataFrame([], "sid string")
    q = reviewing.build_queue(sessions, recs, prior, live, NOW)
    item = q.first()
    assert item.n_turns == 3 and len(item.turns) == 3 and item.project == "app" and item.est_tokens == (len("onetwothree") // 4) + 400
    from turnwise.schemas import VERDICT

    v = spark.createDataFrame(
        [("s1", "s1", 3, None, [(1, "new_task", None)], (True,) * 5, 4, [], "completed", "fine"), ("zz", "zz", 3, None, [], (True,) * 5, 5, [], "completed", "fine")],
        "file_sid string, " + VERDICT,
    )
    store = reviewing.ingest_batch(review.empty_store(spark), v, q, NOW, str(tmp_path / "rejects")).collect()
    assert [(r.sid, r.attempts, r.result) for r in store] == [("s1", 1, None)]
    assert {r.file_sid for r in spark.read.json(str(tmp_path / "rejects")).collect()} == {"s1", "zz"}
    status = review.review_status(
        sessions, review.empty_store(spark), live, v, v, spark.createDataFrame([("2026-01-01", 3)], "date string, judged_total bigint"), F.lit(NOW).cast("timestamp")
    ).first()
    assert (status.judged, status.eligible, status.awaiting, status.since_note, status.note_due) == (0, 1, 2, -3, False)


def test_progress_plan(spark, lines):
    log = Log().human("x").call(None, None, [tool("TodoWrite", "t", todos=[{"content": "a", "status": "completed"}])])
    live = spark.createDataFrame([], "sessionId string, cwd string, startedAt double, name string")
    repos = spark.createDataFrame([], "root string")
    p = progress.build(lines(log), repos, live, "m", "/home/u")
    assert p.projects.first().progress == 100.0 and p.stages.first().title == "(no title)"


def test_price_list_live_registry_deny_list_and_verdicts(spark, tmp_path):
    (tmp_path / "prices.json").write_text(json.dumps({"cache_write_5m": 1.5, "models": {"a": {"in": 1, "out": 2, "window": 10}, "b": {"in": 3, "out": 4, "cache_read": 0.5}}}))
    got = {r.price_id: r for r in tables.read_price_list(spark, str(tmp_path / "prices.json")).collect()}
    assert got["a"].p_in == 1.0 and got["a"].cache_write_5m == 1.5 and got["a"].fast_multiplier == 2.0 and got["b"].own_cache_read == 0.5
    (tmp_path / "live.json").write_text(json.dumps({"pid": 1, "sessionId": "s", "cwd": "/x", "startedAt": 1767225600000}))
    assert tables.read_live_sessions(spark, str(tmp_path / "live.json")).first().sessionId == "s"
    env = spark.createDataFrame([("# TOKEN=aaaaaaaaaaaaaaaaaaaa",), ("A='sixteen-chars-ok!'",), (' B = "bbbbbbbbbbbbbbbbbb=x" ',), ("C=short",), ("nothing",)], "value string")
    assert {r.value for r in tables.deny_list_from_env_lines(env).collect()} == {"sixteen-chars-ok!", "bbbbbbbbbbbbbbbbbb=x"}
    (tmp_path / "store.json").write_text(json.dumps({"s1": {"n_turns": 2, "at": "2026", "judged_by": "r", "result": {"score": 3, "outcome": "partial", "sid": "s1"}}, "s2": {"attempts": 1}}))
    v = tables.read_verdicts(spark, str(tmp_path / "store.json")).collect()
    assert [(r.sid, r.score, r.judged_by, r.judged_at) for r in v] == [("s1", 3, "r", "2026")]
    for d in ("2026-01-01", "2026-02-01"):
        (tmp_path / "coach").mkdir(exist_ok=True)
        (tmp_path / "coach" / f"{d}.json").write_text(json.dumps({"judged_total": 4, "notes": []}))
    assert tables.read_newest_note(spark, str(tmp_path / "coach")).first().date == "2026-02-01"


def test_publish_only_on_change_or_heartbeat(spark, tmp_path):
    df = spark.createDataFrame([("m1", 1, "t1")], "machine string, n int, generated_utc string")
    path = str(tmp_path / "feed")
    first = sinks.publish_if_changed(df, path, None, NOW)
    same = sinks.publish_if_changed(df.withColumn("generated_utc", F.lit("t2")), path, first, NOW + timedelta(seconds=60))
    assert same == first
    beat = sinks.publish_if_changed(df, path, first, NOW + timedelta(seconds=700))
    assert beat[1] > first[1]
    changed = sinks.publish_if_changed(df.withColumn("n", F.lit(2)), path, beat, NOW + timedelta(seconds=701))
    assert changed[0] != beat[0] and spark.read.parquet(path).first().n == 2
    other = df.withColumn("machine", F.lit("m2"))
    sinks.overwrite_machine_partition(other, path)
    assert {r.machine for r in spark.read.parquet(path).collect()} == {"m1", "m2"}
