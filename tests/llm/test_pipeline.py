"""The pipeline's stages against brute-force versions, and the registered queries against their SQL twins."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.tables import ODD_TEXTS
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_jaccard_join import brute as brute_classes
from turnwise.llm import mixing, registry, stages, token_records, toxicity

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations embeddings".split()


def test_stages_are_the_contract():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "token_binary"]


def test_every_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    left = {r.doc_id: r for r in docs.collect()}
    got = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, SF)
        assert got.columns == docs.columns
        rows = {r.doc_id: r for r in got.collect()}
        assert all(rows[i] == left[i] for i in rows)
        if stage is stages.without_toxic:
            score = {r.id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
            want = {i for i in left if score[i] < 0.5}
        elif stage is stages.without_near_copies:
            found = brute_classes([(i, r.text) for i, r in left.items()], 5, 4, 5)
            want = {min(i for i, (c, n) in found.items() if c == root) for root in {c for c, _ in found.values()}}
        elif stage is stages.without_benchmark:
            want = {i for i, r in left.items() if not brute_hits(r.text, items)[1]}
        else:
            _, chances = mixing.probabilities(spark.createDataFrame(list(left.values()), docs.schema), "test")
            chance = {(r.source, r.lang, r.topic): r.probability for r in chances.collect()}
            topics = {r.doc_id: r.t for r in spark.createDataFrame(list(left.values()), docs.schema).select("doc_id", mixing.topic(F.col("text")).alias("t")).collect()}
            drawn = {r.doc_id: r.d for r in docs.select("doc_id", mixing.drawn(docs.doc_id).alias("d")).collect()}
            want = {i for i, r in left.items() if drawn[i] < chance[r.source, r.lang, topics[i]]}
        assert set(rows) == want
        assert want
        left = rows
    tokenizer, start, want = Tokenizer.from_file(token_records.TOKENIZER), 0, []
    for i in sorted(left):
        ids = [*tokenizer.encode(left[i].text, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, got, SF).collect())) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_odd_documents(spark, documents):
    docs = documents([*enumerate(ODD_TEXTS), (None, "no id"), (7, "a repeated row"), (7, "a repeated row")])
    for rows in (docs, docs.limit(0)):
        got = rows
        for _, stage in corpus_pipeline.STAGES:
            got = stage(spark, got, SF)
        assert got.count() <= docs.count()


@pytest.mark.parametrize("name", [m.NAME for m in registry.MODULES if m.ORACLE])
def test_sql_twins(spark, name):
    """With generated code, which the other tests turn off."""
    for key in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode"):
        spark.conf.unset(key)
    try:
        got = registry.queries()[name](spark, SF).toPandas()
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")
        spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = connection.sql(registry.oracle_sql()[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    plain = lambda x: sorted(map(repr, x[names].astype(object).where(x[names].notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)
