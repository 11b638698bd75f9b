from __future__ import annotations

import os

from pyspark.sql import functions as F

from turnwise.llm import common


def test_a_worker_keeps_one_operators_tables():
    freed = []
    common.hold("one", lambda: freed.append("one"))
    common.hold("one", lambda: freed.append("never"))
    assert freed == []
    common.hold("two", lambda: freed.append("two"))
    assert freed == ["one"]
    common.hold("one", lambda: None)
    assert freed == ["one", "two"]


def test_shingles():
    words = common.words_of("A b\tC\x0bd É".encode())
    assert words == [b"a", b"b", b"c", b"d", "É".encode()]
    assert len(common.shingles(words, 3)) == 3 and len(common.shingles(words[:2], 3)) == 1 and len(common.shingles([], 3)) == 0
    assert set(common.shingles(words, 3)) == set(common.shingles(words + words, 3)) & set(common.shingles(words, 3))
    assert len(common.shingles([b"x"] * 50, 3)) == 1


def test_a_filter_lets_all_its_values_through_and_few_others(spark, documents):
    rows = spark.range(20_000).selectExpr("nullif(id * 7, 21) as id")
    test = common.maybe_in(rows.where("id % 2 = 0 or id is null"))
    found = rows.select("id", test(F.col("id")).alias("maybe"))
    assert found.where("(id % 2 = 0 or id is null) and not maybe").isEmpty()
    assert found.where("id % 2 = 1 and maybe").count() < 500
    assert rows.where(common.maybe_in(rows.limit(0))(F.col("id"))).isEmpty()


def test_shuffle_files_go_with_the_table_they_were_for(spark, documents):
    prepared = common.materialize(spark.range(100).groupBy((F.col("id") % 3).alias("k")).count(), "no_shuffle_left")
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true" and prepared.count() == 3
    common.discard(prepared)
    assert not os.path.exists(prepared.scratch_folder.removeprefix("file:"))
