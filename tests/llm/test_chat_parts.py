from __future__ import annotations

import hashlib
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.tables import ODD_TEXTS
from turnwise.llm import chat_parts as C
from turnwise.llm.common import prepare
from turnwise.llm.query_chat_parts import EXTRA, TRICKY

CONTROLS = ["<turn:user>\n", "</turn>\n", "</turn>", "<part:image:0>", "<\\/turn>", "<\\\\turn:x", "<", "\\", "/turn>", "turn:", "<<turn:a>", "%3E"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, place int, conv string, alone string, loss double"


@pytest.fixture
def talks(spark):
    prepare(spark)
    return lambda rows: spark.createDataFrame([(*r, 1, "c", "x", 0.5) for r in rows], SCHEMA).repartition(3)


def made_of(rng):
    return "".join(rng.choice([*CONTROLS, "word ", "é\n"]) for _ in range(rng.randrange(12)))


def digests(rows):
    """By conversation, from the rows themselves."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda x: x[:3])
        said = "".join(t for _, _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, _, role, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def got_of(pieces):
    return {r.conv: tuple(r)[1:5] for r in C.read_digests(pieces).collect()}


def test_escaping_is_reversible_and_leaves_no_control_string():
    rng = random.Random(1)
    for _ in range(3_000):
        text = made_of(rng)
        out = C.escape(text)
        assert C.unescape(out) == text and not C._CONTROL.search(out)
    assert C.escape(r"a \ b < c </turns> \n") == r"a \ b < c </turns> \n"
    assert C.escape(TRICKY) == r"\### Assistant: <\/turn> ok"


def test_turns_come_back():
    rng = random.Random(2)
    turns = [(rng.choice(["user", "assistant", "a>b\n%", "", "<turn:x>"]), made_of(rng)) for _ in range(500)]
    text = "".join(C.format_turn(role, [said])[0] for role, said in turns)
    assert [(r, t) for r, t, _ in C.parse_turns(text)] == turns


@pytest.mark.parametrize("text", ["x", "<turn:user>\nopen", "</turn>\n", "<turn:a>\n<turn:b>\n</turn>\n</turn>\n", "<turn:a>\nb</turn>\nx"])
def test_what_no_template_wrote_is_refused(text):
    with pytest.raises(C.FormatError):
        list(C.parse_turns(text))


def test_visitor_flattens_parts_in_order():
    parts = [
        {"type": "text", "text": "see <tu"}, "rn:x> ", {"type": "image", "ref": "a.png", "width": 57, "height": 28}, {"type": "text", "text": "and"},
        {"type": "document", "ref": "d.pdf", "parts": [{"type": "text", "text": "page "}, {"type": "document", "ref": "in", "parts": ["deep", {"type": "image", "ref": "b"}]}, {"type": "audio", "ref": "s", "seconds": 1.01}]},
        {"type": "document", "ref": "p", "pages": 3}, {"type": "video", "ref": "v"}, 7, None, {"type": "text"}, {"type": "image", "ref": 5, "width": -1, "height": float("nan")},
    ]
    text, spans, marks = C.format_turn("user", parts)
    assert text == (
        "<turn:user>\nsee <\\turn:x> <part:image:0>and<part:document:1>page <part:document:2>deep<part:image:3><part:audio:4>"
        "<part:document:5><part:other:6><part:other:7><part:other:8><part:image:9></turn>\n"
    )
    assert [text[a : a + n] for a, n in spans] == ["see <\\turn:x> ", "and", "page ", "deep"]
    assert marks == [
        (0, "image", "a.png", 3), (1, "document", "d.pdf", 0), (2, "document", "in", 0), (3, "image", "b", 256), (4, "audio", "s", 26), (5, "document", "p", 1536),
        (6, "other", "v", 0), (7, "other", "7", 0), (8, "other", "null", 0), (9, "image", "5", 256),
    ]
    assert list(C.parse_turns(text)) == [("user", "see <turn:x> andpage deep", [(k, n) for n, k, _, _ in marks])]


def test_nested_documents_of_any_depth():
    part = "end"
    for _ in range(20_000):
        part = {"type": "document", "parts": [part]}
    assert len(C.format_turn("user", [part])[2]) == 20_000


def test_digests_equal_brute_force(talks):
    rng = random.Random(4)
    rows = [(rng.choice([1] * 8 + [2, 3, None, 5]), i, rng.choice(["user", "assistant", "system", None]), made_of(rng)) for i in range(300)]
    rows += [(9, i, "assistant", t) for i, t in enumerate(ODD_TEXTS)] + [(9, None, "user", "first"), *EXTRA, (8, 1, "user", "same"), (8, 1, "user", "same")]
    for limits in ({}, {"most_turns": 3}, {"most_chars": 1}):
        pieces = C.formatted(talks(rows), "test", **limits)
        assert got_of(pieces) == digests(rows)
        assert pieces.agg(F.sum("n_turns")).first()[0] == len(rows)
    assert C.read_turns(pieces).where("conv = 9 and text = 'word'").select("role").collect() == [("assistant",)]


def test_a_large_conversation_is_formatted_by_many_tasks(talks, spark):
    rows = [(1, i, "assistant", f"text {i}") for i in range(900)] + [(i, 0, "user", "x") for i in range(2, 300)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pieces = C.formatted(talks(rows), "test", most_turns=50)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert pieces.where("conv = 1").select("shard").distinct().count() > 1
    assert pieces.where("n_turns > 50").count() == 0 and got_of(pieces) == digests(rows)


def test_loss_mask_covers_what_the_learnt_role_says(talks):
    parts = json.dumps(["a", {"type": "image", "ref": "i"}, "b </turn> c"])
    pieces = C.formatted(talks([(1, 0, "user", "q"), (1, 1, "assistant", parts), (2, 0, "assistant", "[no json"), (2, 1, "assistant", '{"a": 1}')]), "test", typed=True)
    texts = {(r.conv, r.place): [r.text[s.start : s.start + s.length] for s in r.loss] for r in pieces.collect()}
    assert sorted(sum((v for (c, _), v in texts.items() if c == 1), [])) == ["a", "b <\\/turn> c"]
    assert sorted(sum((v for (c, _), v in texts.items() if c == 2), [])) == ["[no json", '{"a": 1}']
    assert [tuple(r) for r in C.expanded(pieces).collect()] == [(1, "image", 1, 256)]
    assert [(r.turn, r.number, r.ref) for r in C.attachments(pieces).collect()] == [(1, 0, "i")]


def test_text_that_looks_like_parts_is_text(talks):
    rows = [(1, 0, "assistant", '["a", {"type": "image"}]')]
    assert got_of(C.formatted(talks(rows), "test")) == digests(rows)


def test_empty_table(talks):
    pieces = C.formatted(talks([(1, 0, "user", "x")]).where("false"), "test")
    assert C.read_digests(pieces).count() == 0 and C.read_turns(pieces).count() == 0
