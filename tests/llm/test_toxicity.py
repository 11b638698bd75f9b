from __future__ import annotations

import random
import zlib

import pytest

from tests.llm.tables import ODD_TEXTS
from turnwise.llm import toxicity as X


def distance(a, b):
    """Edits between two words, a swap of neighbours being one."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_edit_distance():
    rng = random.Random(3)
    words = ["idiot", "moron", "scum", "pathetic", "disgusting", "worthless"]
    lexicon = X.Lexicon({w + "$": 1.0 for w in words})
    for _ in range(4000):
        word = list(rng.choice(words))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word))
            kind = rng.randrange(4)
            if kind == 0:
                word[at] = rng.choice("abdeimost")
            elif kind == 1 and len(word) > 2:
                del word[at]
            elif kind == 2:
                word.insert(at, rng.choice("abdeimost"))
            elif at + 1 < len(word):
                word[at], word[at + 1] = word[at + 1], word[at]
        word = "".join(word)
        near = [(distance(word, w), w + "$") for w in words if distance(word, w) <= X.edits_allowed(w + "$")]
        want = min(near) if near else None
        got = lexicon.find(word)
        assert (got and (got[1], got[0])) == want, word


def test_beginnings():
    lexicon = X.Lexicon({"lowei$": 1.0, "veju": 1.0})
    assert lexicon.find("vejuaire") == ("veju", 0) and lexicon.find("vejx") is None and lexicon.find("lowei") == ("lowei$", 0)


def corpus(n=1500, seed=5):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeiou") + rng.choice("bcdfgklmnp") for _ in range(rng.choice([2, 3, 4]))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = rng.random() < 0.2
        if toxic:
            term = rng.choice(["moronic", "dreckwort", "saloperie"])
            at = rng.randrange(40)
            if rng.random() < 0.3:
                at2 = rng.randrange(1, len(term) - 1)
                term = term[:at2] + term[at2 + 1 :]
            words[at] = term
        elif rng.random() < 0.1:
            words[20] = f'he said "{rng.choice(["moronic", "dreckwort"])}" once'
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus()
    docs = documents(rows)
    model = X.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.id: r.score for r in X.score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == bool(labels[i][2]) for i in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values())
    kept = X.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_held_out_labels_are_never_used(spark, documents):
    rows, labels = corpus(400)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    one, two = (X.fit(documents(rows), spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert one == two


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1), (1, 1, 1)], [(1, 1, None), (None, 1, 1)]])
def test_few_labels(spark, documents, labels):
    docs = documents(["a", "b", "c"])
    model = X.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert [r.score for r in X.score(docs, model).collect()] == [float(labels[:1] == [(1, 1, 1)])] * 3


def test_odd_rows(spark, documents):
    rows, labels = corpus(600)
    model = X.fit(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    odd = [*enumerate(ODD_TEXTS), (None, "moronic moronic"), (7, None), (7, None)]
    got = [r.score for r in X.score(documents(odd), model).collect()]
    assert len(got) == len(odd) and sum(s >= 0.5 for s in got) == 1
    assert X.score(documents([]), model).count() == 0
    assert X.without_toxic(documents(odd), model).count() == len(odd) - 1


def test_misspelt_inflections_of_a_learnt_beginning(spark, documents):
    rng = random.Random(9)
    plain = ["".join(rng.choice("aeiou") + rng.choice("bcdfgklmnp") for _ in range(3)) for _ in range(200)]
    rows, labels = [], []
    for i in range(1200):
        words, toxic = [rng.choice(plain) for _ in range(30)], i % 3 == 0
        wrong = toxic and i % 9 == 0
        if toxic:
            words[7] = ("derckig" if wrong else "dreckig") + rng.choice(["e", "er", "es", "em", "en", ""])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = documents(rows)
    model = X.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert any(not e.endswith("$") and "dreckige".startswith(e) for e in model.entries)
    assert X.Lexicon({e: v for e, v in model.entries.items() if e.startswith("dreck")}).find("derckige")[1] == 1
    got = {r.id: r.score for r in X.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i, _ in rows)
