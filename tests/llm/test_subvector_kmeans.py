from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.llm import subvector_kmeans as K
from turnwise.llm.common import prepare

SCHEMA = "vec_id bigint, embedding array<float>, id string, v string, cluster string, n int"


@pytest.fixture
def table(spark):
    prepare(spark)
    return lambda rows: spark.createDataFrame([(i, v, "x", "y", "z", 1) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, dims, k, rounds):
    """Sorted (id, cluster, distance) and the centroids, one vector and centroid after another."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]
    for step in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents)) for _, v in kept]
        if step == rounds:
            break
        for j in range(len(cents)):
            own = [v for (_, v), (_, near) in zip(kept, found, strict=True) if near == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, j, d) for (i, _), (d, j) in zip(kept, found, strict=True)), key=repr), cents


@pytest.mark.parametrize(("dims", "width", "chunk"), [(6, 2, 16), (5, 2, 7), (6, 4, 1000)])
def test_equals_brute_force(table, dims, width, chunk):
    rng = random.Random(dims)
    vector = lambda: [rng.choice([rng.uniform(-1, 1), 0.25, -0.5]) for _ in range(dims)]
    hot = vector()
    rows = [(i, hot if i % 3 == 0 else vector()) for i in range(150)] + [(7, vector()), (7, vector()), (None, vector()), (7, hot)]
    rows += [(900, None), (901, []), (902, [0.1] * (dims + 1)), (903, [None] * dims), (904, [float("nan")] * dims), (905, [float("inf"), *[0.0] * (dims - 1)]), (906, [0.0] * dims)]
    found = K.cluster(K.integers(table(rows), dimensions=dims), "test", k=9, rounds=3, width=width, chunk=chunk)
    expected, cents = brute(rows, dims, 9, 3)
    assert sorted(map(tuple, found.rows.collect()), key=repr) == expected and found.centroids == cents
    marks = {r.cluster: r for r in K.inertia(found).collect()}
    for j in {c for _, c, _ in expected}:
        assert marks[j].cluster_inertia == sum(d for _, c, d in expected if c == j) and marks[j].inertia == sum(d for *_, d in expected)
        assert marks[j].centroid_sha256 == hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()


def test_dictionaries_lose_nothing_and_distances_are_exact():
    rng = np.random.default_rng(1)
    v = rng.integers(-K.LARGEST, K.LARGEST, (200, 7))
    v[50:] = v[rng.integers(0, 5, 150)]
    dictionaries, codes = K.encode(v, 3)
    assert np.array_equal(np.concatenate([d[c] for d, c in zip(dictionaries, codes, strict=True)], axis=1), v)
    assert all(len(d) <= 50 for d in dictionaries)
    cents = rng.integers(-K.LARGEST, K.LARGEST, (4, 7))
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c, strict=True)) for c in cents] for x in v]
    assert K.distances(dictionaries, codes, cents).tolist() == exact
    near = np.array(exact).argmin(axis=1)
    assert K.sums(dictionaries, codes, near, 4).tolist() == [v[near == j].sum(axis=0).tolist() for j in range(4)]


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(table):
    rows = [(i, [0.0, 0.0]) for i in range(5)]
    found = K.cluster(K.integers(table(rows), dimensions=2), "test", k=3)
    assert {(r.cluster, r.distance) for r in found.rows.collect()} == {(0, 0)} and found.centroids == [[0, 0]] * 3


def test_fewer_vectors_than_centroids(table):
    found = K.cluster(K.integers(table([(1, [0.5, 1.0]), (2, [9.0, 1.0])]), dimensions=2), "test")
    assert len(found.centroids) == 2 and found.rows.agg(F.sum("distance")).first()[0] == 0


def test_no_vectors(table):
    found = K.cluster(K.integers(table([(1, None), (2, [1.0])])), "test")
    assert found.rows.count() == 0 and K.inertia(found).count() == 0 and found.centroids == []


def test_components_that_would_overflow_are_refused(table):
    with pytest.raises(Exception, match="beyond"):
        K.cluster(K.integers(table([(1, [1e30, 0.0])]), dimensions=2), "test")
