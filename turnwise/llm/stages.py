"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and gives the documents that it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm import decontaminate, jaccard_join, mixing, token_records, toxicity
from turnwise.llm.common import prepare, read


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half by a model learnt from ``labels`` outside the held-out part."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group linked by five-word shingles at a similarity of 0.8."""
    prepare(spark)
    return jaccard_join.one_of_each(docs, name="stage_near_copies")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ``benchmark`` occurs."""
    return decontaminate.without_hits(docs, read(spark, sf_dir, "benchmark"), name="stage_decontaminate")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn for a raked mix of sources, languages and topics; rare cells never leave less than half of the tokens."""
    prepare(spark)
    return mixing.mixed(docs, "stage_mixing", least_kept=mixing.LEAST_KEPT)


def as_token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the records, read back from the files."""
    prepare(spark)
    index, folder = token_records.write_records(docs, "stage_tokens", most=300_000)  # workers here also hold what earlier stages left
    return token_records.read_digests(index, folder)
