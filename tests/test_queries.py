"""Every registered query against its SQL twin on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")

import __spark_entry__ as entry  # noqa: E402

from turnwise.workload import queries as registered  # noqa: E402

QUERIES, TWINS = registered.queries(), registered.oracle_sql()
CODEGEN = ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")


@pytest.fixture(scope="module", autouse=True)
def generated_code(spark):
    """The plans that users run, unlike the other tests' many tiny ones."""
    before = {k: spark.conf.get(k) for k in CODEGEN}
    for k in CODEGEN:
        spark.conf.unset(k)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_every_query_has_a_twin():
    assert set(TWINS) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(TWINS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_matches_its_twin(name, spark, duck):
    df = QUERIES[name](spark, DATA)
    rel = duck.sql(TWINS[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
