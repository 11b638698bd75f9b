"""Where a query and its SQL differed on larger tables only: words, ties, and numbers halfway between two others."""

import pytest
from pyspark.sql import functions as F
from test_rules import comp, one, table

from turnwise.functions import formats
from turnwise.operators import progress
from turnwise.streaming import whole_fold
from turnwise.workload import by_session, by_tables

duckdb = pytest.importorskip("duckdb")


def test_lossy_compactions_have_the_word_of_the_sql(spark, monkeypatch):
    lossy = [one(human_turns=40, reexplain=4, reexplain_after_compaction=3, turns_after_compaction=10, compactions=[comp()])] * 5
    monkeypatch.setattr(by_session.silver, "prepared", lambda *_: table(spark, *lossy))
    assert by_session.compaction_verdict(spark, "").first().verdict == "lossy"


def test_of_two_todos_with_one_position_the_first_written_is_current(spark, tmp_path):
    for name, rows in (
        ("customer", "select 1L c_custkey, 3 c_nationkey, 'c' c_name"),
        ("orders", "select 7L o_orderkey, 1L o_custkey, 500000D o_totalprice, date'2024-01-01' o_orderdate, '1-URGENT' o_orderpriority"),
        ("lineitem", "select 7L l_orderkey, 2 l_linenumber, 'N' l_returnflag, 'O' l_linestatus, 30D l_quantity, part l_partkey, 1L l_suppkey from values (5L), (9L), (4L) t(part)"),
    ):
        spark.sql(rows).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    projects, stages, subtasks = by_tables.progress_tables(spark, str(tmp_path))
    for rows in (subtasks, subtasks.orderBy("text"), subtasks.orderBy(F.desc("text"))):
        assert [r.current_todo for r in progress.live_now(projects, stages, rows).collect()] == ["part 5"]


def test_minutes_halfway_are_those_of_the_sql(spark):
    halves = spark.range(50_000).select(((2 * F.col("id") + 1) * 300_000).alias("us"))
    minutes = formats.minutes_between(F.timestamp_micros(F.lit(0).cast("bigint")), F.timestamp_micros("us"))
    got = {r.us: r.m for r in halves.select("us", minutes.alias("m")).collect()}
    sql = "select (2 * i + 1) * 300000::bigint as us, round_even(us / 60000000.0::double, 2) from range(50000) t(i)"
    assert got == dict(duckdb.sql(sql).fetchall())
    assert got == {us: whole_fold.minutes(0, us) for us in got}


def test_labels_halfway_are_those_of_the_sql(spark):
    n = F.col("id")
    rows = spark.range(7740, 172_800, 180).union(spark.range(1_050_000, 40_000_000, 50_000))
    got = rows.select("id", formats.duration(n.cast("double")), formats.byte_size(n), formats.tokens(n)).collect()
    sql = """select n, case when n < 36000 then printf('%.1fh', n / 3600.0::double) when n < 172800 then printf('%.0fh', n / 3600.0::double) else floor(n / 86400.0::double + 0.5)::bigint || 'd' end,
      case when n >= 1000000 then printf('%.1f MB', n / 1e6::double) else floor(n / 1e3::double + 0.5)::bigint || ' KB' end,
      case when n >= 1000000 then printf('%.1fM', n / 1e6::double) else floor(n / 1e3::double + 0.5)::bigint || 'K' end
      from (select unnest(range(7740, 172800, 180)) as n union all select unnest(range(1050000, 40000000, 50000)))"""
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(sql).fetchall())
