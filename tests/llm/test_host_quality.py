from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tests.llm.tables import ODD_TEXTS
from turnwise.llm import host_quality as Q

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if x.strip(SPACE)]
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {r for r, n in Counter(runs).items() if n > 1}
    repeated = {i + j for i, r in enumerate(runs) if r in twice for j in range(3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), failed


def test_measures_equal_brute_force(documents):
    rng = random.Random(1)
    texts = [*ODD_TEXTS, *(rng.choice([" ", "\n", "\t\n"]).join(rng.choice(["a", "b", "c", "#d", "é|"]) for _ in range(rng.choice([1, 2, 3, 8, 60, 200]))) for _ in range(60))]
    rows = list(enumerate(texts))
    got = sorted((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in Q.measures(documents(rows)).collect())
    assert got == [(i, *brute(t)) for i, t in rows]


GOOD = " ".join(f"w{i}" for i in range(60))


def test_host_verdicts(documents):
    rows = [(i, "short", "en", "bad") for i in range(60)] + [(100 + i, GOOD, "en", "good") for i in range(60)]
    rows += [(200, GOOD, "en", "bad"), (201, "short", "en", "good"), (300, GOOD, "en", None), (300, GOOD, "en", None), (301, "short", "en", "tiny")]
    got = {(r.id, r.kept) for r in Q.judged(documents(rows), "test").collect()}
    assert (200, False) in got and (201, False) in got and (100, True) in got and (300, True) in got


def test_prior_shrinks_small_hosts(spark):
    hosts = spark.createDataFrame([("a", 100, 10), ("b", 100, 60), ("c", 1, 1)], "host string, n_rows long, n_failed long")
    alpha, beta = Q.beta_prior(hosts)
    assert 0.2 < alpha / (alpha + beta) < 0.5
    assert (1 + alpha) / (1 + alpha + beta) < 0.9
    assert Q.beta_prior(hosts.where("false")) == (0.5, 0.5)
    even = spark.createDataFrame([("a", 50, 10), ("b", 50, 10)], "host string, n_rows long, n_failed long")
    assert sum(Q.beta_prior(even)) == pytest.approx(100)


def test_empty_table(documents):
    assert Q.judged(documents([]), "test").count() == 0


def test_no_python_in_the_plan(documents):
    plan = Q.measures(documents(["a b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
