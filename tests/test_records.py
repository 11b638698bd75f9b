from tests.transcript_log import Log, tool, use
from pyspark.sql import functions as F

from turnwise.operators import records as R


def test_what_counts_as_a_human_turn(records):
    log = Log()
    log.human("hello there")
    log.human("meta", isMeta=True).human("side", isSidechain=True).human("summary", isCompactSummary=True)
    log.human("<command-name>/x</command-name>").human("   ").human("[Request interrupted by user]")
    log.human("typed", origin={"kind": "human"}).human("hook", origin={"kind": "hook"})
    log.add(type="user", message={"content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]})
    log.result("t1")
    got = {r.text for r in records(log).filter("is_human").collect()}
    assert got == {"hello there", "typed", "a\nb"}


def test_plain_text_that_looks_like_a_list_stays_text(records):
    r = records(Log().human('[{"type":"tool_result"}]')).first()
    assert r.text == '[{"type":"tool_result"}]' and not r.has_tool_result and r.is_human


def test_bad_and_unmarked_lines_are_left_out(lines, spark):
    log = Log().human("one").raw('{"type":"user","sess').raw('{"type":"progress","cwd":"/elsewhere"}')
    log.raw('{"type": "user", "message": {"content": "spaced"}}')
    df = lines(log)
    assert [r.text for r in R.read_records(df).orderBy("line_no").collect()] == ["one", "spaced"]
    assert R.count_bad_lines(df).first().bad_lines == 1


def test_mixed_content_keeps_its_objects(records):
    r = records(Log().add(type="user", message={"content": ["junk", {"type": "text", "text": "kept"}]})).first()
    assert r.text == "kept"


def test_denials_and_interruptions(records):
    phrase = "User chose to stay in plan mode and continue planning"
    log = Log().result("a", "no", toolDenialKind="user-rejected").result("b", phrase, toolDenialKind="permission-rule")
    log.result("c", [{"type": "text", "text": phrase}], toolDenialKind="permission-rule")
    log.result("d", "denied", toolDenialKind="permission-rule").result("e", "x", toolDenialKind="hook")
    log.human("[Request interrupted by user for tool use]").human("  [Request interrupted by user]", isMeta=True)
    got = [(r.denial, r.interrupt) for r in records(log).orderBy("line_no").collect()]
    assert [d for d, _ in got] == ["user", "plan", "plan", "auto", "auto", None, None]
    assert [i for _, i in got][-2:] == ["tool", "run"]


def test_context_prefers_the_total_and_falls_back_to_the_parts(records):
    log = Log().call("a", use(cr=100, inp=5, cc=50, c5=1)).call("b", use(cr=100, inp=5, c5=20, c1h=30)).call("c")
    ctx = [r.c for r in records(log).orderBy("line_no").select(R.call_context(F.col("usage")).alias("c")).collect()]
    assert ctx == [155, 155, 0]


def test_result_size_counts_strings_lists_and_missing_bodies(records):
    log = Log().result("a", "x" * 7).result("b", [{"type": "text", "text": "hi"}]).result("c", None)
    sizes = [r.blocks[0].result_chars for r in records(log).orderBy("line_no").collect()]
    assert sizes[0] == 7 and sizes[1] == len('[{"type":"text","text":"hi"}]') and sizes[2] == 4


def test_only_real_todo_calls_count(records):
    todos = [{"content": "a", "status": "completed"}, {"content": "b", "status": "pending"}]
    log = Log().call(blocks=[{"type": "text", "text": 'say "name":"TodoWrite"'}]).call(blocks=[tool("TodoWrite", "t", todos=todos)])
    blocks = R.explode_blocks(records(log))
    assert [len(r.todos) for r in R.extract_todos(blocks).collect()] == [2]


def test_model_window(spark):
    df = spark.createDataFrame([("x-Haiku-3",), ("big",), (None,)], "m string")
    assert [r.w for r in df.select(R.model_window(F.col("m")).alias("w")).collect()] == [200000, 1000000, 1000000]
