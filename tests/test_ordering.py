import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnwise.operators import ordered
from turnwise.operators.ordering import (
    Ordering, by_number, by_time, latest, medians, previous, running_max, running_min, running_sum, scan, top_k, total, value_segments,
)


def _rows(n=400, seed=3):
    rng = random.Random(seed)
    # One key holds a third of all rows.
    return [("hot" if rng.random() < 0.33 else f"k{rng.randrange(20)}", i, rng.choice([None, 1, 2, 5]), rng.random() < 0.2) for i in range(n)]


def test_two_level_scan_equals_the_plain_window(spark):
    df = spark.createDataFrame(_rows(), "k string, i bigint, v bigint, b boolean")
    def folds():
        v = F.col("v")
        return dict(s=running_sum(v), lo=running_min(v), hi=running_max(v), last=latest(v), prev=previous(v), all=total(F.sum, v), top=total(F.max, v))

    def run(o):
        return sorted(map(tuple, scan(df, o, **folds()).select("k", "i", "s", "lo", "hi", "last", "prev", "all", "top").collect()))

    plain = run(Ordering(("k",), ("i",)))
    for rows in (1, 7, 50, 10_000):
        got = run(by_number(("k",), "i", rows))
        assert [g[:7] for g in got] == [p[:7] for p in plain]
        w = Window.partitionBy("k")
        want = sorted(map(tuple, df.select("k", "i", F.sum("v").over(w), F.max("v").over(w)).collect()))
        assert [(g[0], g[1], g[7], g[8]) for g in got] == want


def test_two_level_scan_by_time(spark):
    df = spark.createDataFrame(_rows(200), "k string, i bigint, v bigint, b boolean").withColumn("ts", F.timestamp_seconds(F.col("i") * 37))
    plain = scan(df, Ordering(("k",), ("ts", "i")), n=running_sum(F.lit(1)))
    cut = scan(df, by_time(("k",), "ts", "i", 60), n=running_sum(F.lit(1)))
    assert sorted(map(tuple, plain.select("k", "i", "n").collect())) == sorted(map(tuple, cut.select("k", "i", "n").collect()))


def test_medians_match_the_definition(spark):
    import statistics

    rng = random.Random(1)
    data = [("a", rng.choice([0.0, 1.5, 2.25, 1e6, -3.0]) * rng.randrange(1, 9)) for _ in range(101)] + [("b", 2.0), ("b", 5.0), ("c", None)]
    df = spark.createDataFrame(data, "k string, x double")
    got = {r.k: r.median for r in medians(df, ["k"], "x").collect()}
    assert got == {k: statistics.median([x for kk, x in data if kk == k and x is not None]) for k in ("a", "b")}


def test_clustered_values_are_spread_over_segments(spark):
    df = spark.range(20000).select(F.lit("k").alias("k"), (F.col("id") + 1_700_000_000_000).alias("x"))
    sizes = [r["count"] for r in value_segments(df, "x", 64).groupBy("__cut").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 4 * 20000 / 64
    assert medians(df, ["k"], "x", cuts=64).first().median == 1_700_000_009_999.5


def test_repeated_wording_against_brute_force(spark):
    rng = random.Random(5)
    data = [(f"k{rng.randrange(3)}", i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 9)))) for i in range(120)]
    df = spark.createDataFrame(data, "k string, i bigint, t string")
    memory, want = {}, {}
    for k, i, t in sorted(data, key=lambda d: d[1]):
        w = t.split()
        runs = {tuple(w[j : j + 3]) for j in range(len(w) - 2)}
        seen = memory.setdefault(k, set())
        want[(k, i)] = bool(runs & seen)
        seen |= runs
    got = {(r.k, r.i): r.repeated for r in ordered.repeated_wording(df, ["k"], "i", "t", n=3).collect()}
    assert got == want


def test_series_keeps_ends_and_replaces_the_middle_with_the_peak(spark):
    pts = [("k", i, float(i), 1000 if i == 57 else i) for i in range(200)]
    df = spark.createDataFrame(pts, "k string, i bigint, x double, y bigint")
    series = ordered.downsample_series(df, by_number(("k",), "i", 16), "x", "y", 32).first().series
    step = 199 / 31.0
    want = [(float(round(j * step)), round(j * step)) for j in range(32)]
    want[16] = (57.0, 1000)
    assert [(p["min"], p["ctx"]) for p in series] == sorted(want, key=lambda p: p[0])


def test_results_answer_only_a_pending_use(spark):
    rows = [("p", 0, "a", True, "Read"), ("p", 1, "a", False, None), ("p", 2, "a", False, None), ("p", 3, "b", False, None), ("p", 4, "a", True, "Edit"), ("p", 5, "a", False, None)]
    df = spark.createDataFrame(rows, "path string, i bigint, id string, u boolean, tool string")
    got = {r.i: r.tool for r in ordered.match_results(df, by_number(("path",), "i", 2), "id", F.col("u"), ["tool"]).collect()}
    assert got == {1: "Read", 2: None, 3: None, 5: "Edit"}


def test_top_k_breaks_ties_by_the_given_order(spark):
    df = spark.createDataFrame([("k", "a", 2), ("k", "b", 3), ("k", "c", 2)], "k string, x string, n bigint")
    assert [r.x for r in top_k(df, ["k"], [F.desc("n"), F.asc("x")], 2).orderBy("rank").collect()] == ["b", "a"]
