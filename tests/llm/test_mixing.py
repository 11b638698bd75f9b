from __future__ import annotations

import hashlib

import pytest

from tests.llm.tables import ODD_TEXTS
from turnwise.llm import mixing as M
from turnwise.llm import stages


def test_rake_reaches_the_targets(spark):
    cells = [("a", "en", 100), ("a", "de", 50), ("b", "en", 10), ("b", "de", 40)]
    frame = spark.createDataFrame(cells, "source string, lang string, tokens long")
    share = lambda rows: spark.createDataFrame(rows, "value string, share double")
    raked = {(r.source, r.lang): r.raked for r in M.rake(frame, {"source": share([("a", 0.5), ("b", 0.5)]), "lang": share([("en", 0.7), ("de", 0.3)])}, "test", rounds=30).collect()}
    assert sum(v for (s, _), v in raked.items() if s == "a") == pytest.approx(100)
    assert sum(v for (_, x), v in raked.items() if x == "en") == pytest.approx(140)
    # Raking leaves the odds ratio as it was.
    ratio = lambda g: g("a", "en") * g("b", "de") / (g("a", "de") * g("b", "en"))
    counted = {(s, x): n for s, x, n in cells}
    assert ratio(lambda s, x: raked[s, x]) == pytest.approx(ratio(lambda s, x: counted[s, x]))


def brute(rows):
    """Probability of every cell in plain Python."""
    cells = {}
    for _, text, lang, source in rows:
        t = text or ""
        size = len(t)
        topic = "table" if t.count("|") * 50 > size else "symbols" if sum(t.count(c) for c in "#*$%&<>") * 20 > size else "note" if size < 500 else "prose"
        key = (source or "", lang or "", topic)
        cells[key] = cells.get(key, 0) + len(t.split(None) if t.isascii() else [w for w in t.replace("\t", " ").split(" ") if w])
    raked, whole = {k: float(v) for k, v in cells.items()}, sum(cells.values())
    for _ in range(M.ROUNDS):
        for d in range(3):
            held, goal = {}, {}
            for k, v in raked.items():
                held[k[d]] = held.get(k[d], 0) + v
                goal[k[d]] = goal.get(k[d], 0) + cells[k]
            goal = {k: v**M.TEMPER for k, v in goal.items() if v}
            total = sum(goal.values())
            raked = {k: v * goal.get(k[d], 0) / total * whole / held[k[d]] if held[k[d]] else 0.0 for k, v in raked.items()}
    most = max(raked[k] / cells[k] for k in cells if cells[k])
    return {k: raked[k] / cells[k] / most if cells[k] else 1.0 for k in cells}


def test_probabilities_equal_brute_force(documents):
    rows = [(i, t, "en", "src0") for i, t in enumerate(ODD_TEXTS) if t is None or "\x00" not in t and "\x0b" not in t]
    rows += [(100 + i, f"some words {i} " * (5 + i), ["en", "de", None][i % 3], ["src0", "src1", None][i * i % 3]) for i in range(60)]
    _, chances = M.probabilities(documents(rows), "test")
    got = {(r.source, r.lang, r.topic): r.probability for r in chances.collect()}
    assert got == pytest.approx(brute(rows))
    assert max(got.values()) == pytest.approx(1)


def test_draw_is_repeatable_and_keeps_columns(documents):
    rows = [(i, f"some words {i} " * (5 + i % 7), ["en", "de"][i % 5 == 0], f"src{i % 3}") for i in range(200)]
    docs = documents(rows)
    kept = M.mixed(docs, "test")
    assert kept.columns == docs.columns
    first = sorted(r.doc_id for r in kept.collect())
    assert first == sorted(r.doc_id for r in M.mixed(documents(rows, parts=5), "test").collect())
    _, chances = M.probabilities(docs, "test")
    chance = {(r.source, r.lang): r.probability for r in chances.collect()}
    drawn = lambda i: int(hashlib.md5(f"{i}|mix".encode()).hexdigest()[:12], 16) / 16**12
    assert first == [i for i, _, lang, source in rows if drawn(i) < chance[source, lang]]
    assert 100 < len(first) < 200


def test_empty_table_and_missing_columns(documents):
    assert M.mixed(documents([]), "test").count() == 0
    assert M.mixed(documents(["a b", None]).drop("lang", "source"), "test").count() == 2


def test_a_tiny_cell_leaves_the_kept_share(spark, documents):
    rows = [(i, f"some words {i} " * (40 + i % 7), ["en", "de"][i % 3 == 0], f"src{i % 4}") for i in range(900)]
    tiny = (-1, "one two three", "xx", "unseen")

    def share(rows, **how):
        found, chances = M.probabilities(documents(rows), "test", **how)
        got = found.join(chances, list(M.DIMENSIONS)).collect()
        assert all(0 <= r.probability <= 1 for r in got)
        return sum(r.n_tokens * r.probability for r in got) / sum(r.n_tokens for r in got), {r.id: r.probability for r in got}

    assert share([*rows, tiny])[0] < 0.4
    with_tiny, chance = share([*rows, tiny], least_kept=M.LEAST_KEPT)
    assert with_tiny == pytest.approx(M.LEAST_KEPT) and chance[-1] == 1
    # The stage of the pipeline has the bound.
    kept = stages.mixed(spark, documents([*rows, tiny]), "")
    assert 390 < kept.count() < 520 and kept.where("doc_id = -1").count() == 1


def test_solved_share(spark):
    frame = spark.createDataFrame([("a", 100, 10.0), ("b", 100, 50.0), ("c", 10, 10.0), ("d", 50, 0.0)], "source string, tokens long, raked double")
    for kept in (0.2, 0.5, 0.8):
        c = M.solved(frame, kept)
        assert sum(min(t, c * r) for t, r in ((100, 10.0), (100, 50.0), (10, 10.0))) == pytest.approx(kept * 260)
    c = M.solved(frame, 1.0)  # more than the cells that may be kept have
    assert min(c * 10, c * 10 / 10, c * 50 / 100) >= 1
    assert M.solved(frame.where("false"), 0.5) == 0.0
