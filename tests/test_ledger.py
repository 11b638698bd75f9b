"""Each id counts once, however far apart its copies are."""

import random

import numpy as np

from turnwise.sources import snapshots
from turnwise.streaming import ledger as L

SCHEMA = "path string, id string, line bigint, n bigint"


def test_replays_count_once_and_a_batch_that_runs_again_gives_the_same_rows(spark, tmp_path):
    rng = random.Random(2)
    ids = L.Ledger(str(tmp_path / "l"), "m1", ["path", "id"], buckets=4)
    seen: dict = {}
    for number in range(L.MOST_PARTS + 3):
        rows = [("/p", f"id{rng.randrange(60)}", line, number) for line in range(12)] + [("/q", f"q{number}", 0, number), ("/q", f"q{number}", 1, number)]
        want = {}
        for path, key, line, n in rows:
            if (path, key) not in seen:
                want.setdefault((path, key), (path, key, line, n))
        batch = spark.createDataFrame(rows, SCHEMA)
        for _ in range(2):
            assert sorted(map(tuple, ids.fresh(batch, number, ["line"]).collect())) == sorted(want.values())
        seen |= want
    state = snapshots.current(spark, str(tmp_path / "l"), "m1")
    assert state.version == L.MOST_PARTS + 3
    per_bucket = [part.split("/")[0] for part in state.parts[L.IDS]]
    assert max(map(per_bucket.count, set(per_bucket))) <= L.MOST_PARTS
    assert snapshots.read(spark, state, L.IDS).count() == len(seen)


def test_null_keys_and_an_empty_batch(spark, tmp_path):
    ids = L.Ledger(str(tmp_path / "l"), "m1", ["path", "id"], buckets=2)
    empty = spark.createDataFrame([], SCHEMA)
    assert ids.fresh(empty, 0, ["line"]).count() == 0
    one = spark.createDataFrame([("/p", None, 0, 1), ("/p", None, 1, 1), ("/p", "a", 2, 1)], SCHEMA)
    assert ids.fresh(one, 1, ["line"]).count() == 3
    assert ids.fresh(one.where("id = 'a'"), 2, ["line"]).count() == 0


def test_a_filter_lets_every_known_id_through():
    rng = np.random.default_rng(1)
    known, other = rng.integers(-(2**63), 2**63 - 1, 5_000), rng.integers(-(2**63), 2**63 - 1, 5_000)
    field = np.zeros(L.BITS // 8, dtype=np.uint8)
    at = L.bits_of(known).ravel()
    np.bitwise_or.at(field, at >> 3, (1 << (at & 7)).astype(np.uint8))
    may = lambda h: np.all(field[L.bits_of(h) >> 3] & (1 << (L.bits_of(h) & 7)).astype(np.uint8), axis=1)
    assert may(known).all() and may(other).mean() < 0.01
