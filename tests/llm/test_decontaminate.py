from __future__ import annotations

import random
import re

from tests.llm.tables import ODD_TEXTS
from turnwise.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(text, items):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, body in items:
        own = WORD.findall((body or "").translate(LOWER))
        n = min(10, len(own))
        if not n:
            continue
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return len(words), len(hit), sorted(str(i) for i in found if i is not None)


def run(spark, documents, rows, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = D.contamination(documents(rows), benchmark)
    return sorted((r.id if r.id is not None else -1, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect())


def expected(rows, items):
    return sorted((i if i is not None else -1, n, h, tuple(f)) for i, text in rows for n, h, f in [brute(text, items)])


def test_equals_brute_force(spark, documents):
    rng = random.Random(4)
    vocabulary = ["Alpha", "beta", "gamma", "delta", "Été", "x1"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 10, 11, 25])))) for i in range(25)]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([2, 9, 30, 80]))]
        if rng.random() < 0.5:
            body = rng.choice(items)[1].split()
            start = rng.randrange(len(body))
            at = rng.randrange(len(words))
            words[at:at] = body[start : start + rng.choice([9, 10, 12, 30])]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    assert run(spark, documents, rows, items) == expected(rows, items)


def test_odd_rows(spark, documents):
    rows = [*enumerate(ODD_TEXTS), (3, "word"), (None, "a b c d e f g h i j k"), (None, "a b c d e f g h i j k")]
    items = [(1, None), (2, ""), (3, "word"), (3, "word"), (4, "A B c d e f g h i j"), (5, "long text here " * 5), (None, "same text")]
    assert run(spark, documents, rows, items) == expected(rows, items)


def test_empty_tables(spark, documents):
    assert run(spark, documents, [], [(1, "a b")]) == []
    assert run(spark, documents, [(1, "a b")], []) == [(1, 2, 0, ())]


def test_without_hits(spark, documents):
    docs = documents([(1, "a b c d e f g h i j"), (2, "clean words"), (2, "x a b c d e f g h i j"), (None, "clean"), (None, "a b c d e f g h i j")])
    kept = D.without_hits(docs, spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "clean"), (2, "clean words")]


def test_no_python_in_the_plan(spark, documents):
    found = D.contamination(documents(["a b"]), spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
