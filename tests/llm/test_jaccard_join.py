from __future__ import annotations

import random
import re
from collections import Counter
from pathlib import Path

import pytest

from tests.llm.tables import ODD_TEXTS
from turnwise.llm import jaccard_join as J
from turnwise.llm.common import components, words_of
from turnwise.session import scratch_root


def brute(rows, width, num, den):
    """Component and set size of every (id, text) by comparing sets that share a shingle."""
    sets, inverse = {}, {}
    for i, text in rows:
        w = words_of((text or "").encode())
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        for s in sets[i]:
            inverse.setdefault(s, []).append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, own in sets.items():
        for j, common in Counter(j for s in own for j in inverse[s] if j < i).items():
            if common * den >= num * (len(own) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (root(i), len(s)) for i, s in sets.items()}


def near_copies(seed):
    """Groups of edited copies, copies of copies, and texts made of a few frequent words."""
    rng = random.Random(seed)
    vocabulary, texts = [f"w{i}" for i in range(300)], []
    for size, copies in ((150, 70), (40, 30), (300, 12), (12, 25), (5, 10), (60, 1)):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            words = base if rng.random() < 0.7 or not texts else rng.choice(texts).split()
            words = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4, 6])):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[f"n{rng.randrange(10**6)}"], [rng.choice(vocabulary[:5])], [], [words[at], rng.choice(vocabulary)]]) or [words[0]]
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize(("seed", "paired", "differences", "width", "num", "den"), [(0, 8, 128, 3, 9, 10), (1, 3, 3, 5, 4, 5), (2, 2, 4, 1, 3, 5)])
def test_equals_brute_force(documents, monkeypatch, seed, paired, differences, width, num, den):
    monkeypatch.setattr(J, "PAIRED", paired)
    monkeypatch.setattr(J, "PAIRED_DIFFERENCES", differences)
    rows = list(enumerate(near_copies(seed)))
    got = {r.id: (r.component_id, r.n_shingles) for r in J.jaccard_classes(documents(rows), width=width, num=num, den=den).collect()}
    assert got == brute(rows, width, num, den)


def test_slices_of_tokens_count_as_one(documents, monkeypatch):
    monkeypatch.setattr(J, "SLICE_TOKENS", 50)
    rows = list(enumerate(near_copies(3)))
    got = {r.id: (r.component_id, r.n_shingles) for r in J.jaccard_classes(documents(rows), width=3, num=9, den=10).collect()}
    assert got == brute(rows, 3, 9, 10)


def test_tables_between_are_deleted(spark, documents):
    name = f"between{random.randrange(10**9)}"
    rows = [(i, text) for i, text in enumerate(near_copies(4))] + [(3, "a text of an id twice"), (3, "another text of that id")]
    kept = J.one_of_each(documents(rows), width=3, num=9, den=10, name=name)
    n = kept.count()
    found = Path(scratch_root(spark).removeprefix("file:"), "turnwise")
    left = {f.name.rpartition("-")[0].removeprefix(f"{name}_") for f in found.iterdir() if f.name.startswith(name)}
    assert not {x for x in left if not re.fullmatch("rows|known|kept|ids|chance|tied_e[0-9]+", x)} and kept.count() == n


def test_odd_rows(documents):
    rows = list(enumerate(ODD_TEXTS))
    got = {r.id: (r.component_id, r.n_shingles) for r in J.jaccard_classes(documents(rows)).collect()}
    assert got == brute(rows, 5, 4, 5)


def test_repeated_and_null_ids(documents):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, "lone text of a null id"), (3, "other words of this one"), (3, "quite another text again")]
    got = sorted(((r.id, r.component_id) for r in J.jaccard_classes(documents(rows)).collect()), key=str)
    assert got == sorted([(7, 7), (7, 7), (None, 7), (None, None), (3, 3), (3, 3)], key=str)


def test_empty_table(documents):
    assert J.jaccard_classes(documents([])).count() == 0
    assert J.one_of_each(documents([])).count() == 0


def test_one_of_each(documents):
    rows = [(5, "a b c d e f g"), (2, "A b c d e f g"), (2, "A b c d e f g"), (9, "z y x w v u t"), (1, None), (4, ""), (4, "")]
    docs = documents(rows)
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, ""), (2, "A b c d e f g"), (4, ""), (4, ""), (9, "z y x w v u t")]


def test_threshold_bounds(documents):
    with pytest.raises(ValueError, match="between"):
        J.jaccard_classes(documents(["a"]), num=1, den=2)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 100)], "a long, b long")
    got = {r.node: r.component for r in components(edges, "test").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
