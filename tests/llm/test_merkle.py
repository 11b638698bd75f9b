from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.tables import ODD_TEXTS
from turnwise.llm import merkle as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in M.COLUMNS))


def climb(digests, arity=16):
    """The root of a list, and for every member the (left, right) siblings level by level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, place in enumerate(at):
            start = place - place % arity
            paths[i].append(("".join(level[start:place]), "".join(level[place + 1 : start + arity])))
            at[i] = place // arity
        level = [h(*level[i : i + arity]) for i in range(0, len(level), arity)]
    return level[0], paths


def brute(rows, arity=16):
    """Sorted (doc_id, leaf, subroot, root, proof)."""
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    grown = {s: climb([x[2] for x in sorted(by[s])], arity) for s in names}
    root, over = climb([grown[s][0] for s in names], arity)
    out = []
    for s, above in zip(names, over, strict=True):
        for (there, doc_id, own), path in zip(sorted(by[s]), grown[s][1], strict=True):
            full = path + above
            now = own
            for left, right in full:
                now = h(left, now, right)
            assert now == root
            out.append((doc_id if there else None, own, grown[s][0], root, h(*(x for p in full for x in p))))
    return sorted(out, key=repr)


def proved(docs, arity=16, **how):
    found = M.manifest(M.hashed(docs, **how), "test", arity).proofs()
    return found.select("id", "digest", "subroot", "root", M.proof(F.col("path")).alias("proof"), M.folded(F.col("digest"), F.col("path")).alias("folded"))


def held(docs, arity=16):
    rows = proved(docs, arity).collect()
    assert all(r.folded == r.root for r in rows)
    return sorted((tuple(r)[:5] for r in rows), key=repr)


def as_dicts(docs):
    return [r.asDict() for r in docs.collect()]


@pytest.mark.parametrize("arity", [2, 16])
def test_equals_brute_force(documents, arity):
    rng = random.Random(3)
    rows = [(i, f"Text {i % 7}", rng.choice(["en", None]), rng.choice(["hot"] * 6 + ["b", "é", "", None])) for i in rng.sample(range(2_000), 420)]
    rows += [(5000 + i, t, "en", "odd") for i, t in enumerate(ODD_TEXTS)] + [(None, "no id", "en", "hot"), (None, None, None, None), (7, "alone", "en", "single")]
    rows += [(1, "same", "en", "hot")] * 3 + [(1, "other", "en", "hot")]
    docs = documents(rows)
    assert held(docs, arity) == brute(as_dicts(docs), arity)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 256, 257])
def test_edges_of_the_levels(documents, n):
    docs = documents([(i, "t") for i in range(n)])
    assert held(docs) == brute(as_dicts(docs))


def test_many_sources(documents):
    docs = documents([(i, "t", "en", f"s{i % 40}") for i in range(60)])
    assert held(docs) == brute(as_dicts(docs))


def test_tampering_is_found(documents):
    rows = [(i, t) for i, t in enumerate(["Upper", "lower", None, "ABC", "é É"] * 10)]
    changed = {"text": F.translate("text", "ABCU", "abcu")}
    found = M.manifest(M.hashed(documents(rows), changed=changed), "test").proofs()
    for r in found.select("id", "root", M.folded(F.col("other"), F.col("path")).alias("folded")).collect():
        text = rows[r.id][1] or ""
        assert (r.folded == r.root) == (text.translate(str.maketrans("ABCU", "abcu")) == text)
        assert zlib.crc32(b"0") == 4108050209  # the polynomial that crc32() of Spark uses too


def test_node_labels(documents):
    made = M.manifest(M.hashed(documents([(i, "t") for i in range(300)])), "test")
    assert [df.count() for df in made.sources] == [300, 19, 2, 1]
    for height, nodes in enumerate(made.sources[1:], 1):
        for r in nodes.collect():
            assert r.lo % 16**height == 0 and r.hi - r.lo <= 16**height
            assert [c.lo for c in r.children][1:] == [c.hi for c in r.children][:-1]


def test_empty_table(documents):
    assert proved(documents([])).count() == 0
