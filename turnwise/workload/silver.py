"""Typed tables written once per application and input folder.

The session and rule queries share them, as jobs on a cluster would share the
silver layer.  Every table is written by Spark from the whole input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import records as R, rules, sessions as S
from turnwise.session import write_scratch
from turnwise.workload import adapter as A

_WRITTEN: dict[tuple[str, str, str], tuple[str, object]] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write ``build()`` the first time it is asked for; read it back afterwards."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        table = build()
        _WRITTEN[key] = (write_scratch(table, name), table.schema)
    path, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "records", lambda: R.read_records(A.event_lines(A.load(spark, sf_dir, "events"))))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "turn_state", lambda: S.turn_state(records(spark, sf_dir)))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "api_calls", lambda: S.api_calls(state(spark, sf_dir)))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "sessions", lambda: S.build_sessions(records(spark, sf_dir)))


def session_number() -> F.Column:
    return F.regexp_extract("path", "([0-9]+)\\.jsonl$", 1).cast("bigint")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` and ``documents`` as review verdicts: score, missing items, turn causes."""
    labels = A.load(spark, sf_dir, "labels")
    d, q, t = F.col("doc_id"), F.col("quality").cast("bigint"), F.col("toxic").cast("bigint")
    items = F.array(*[F.lit(i) for i in rules.fixed.MISSING_ITEMS])
    causes = F.array(*[F.lit(c) for c in rules.fixed.CAUSES])
    turn = F.struct(
        F.lit(1).cast("bigint").alias("i"),
        F.when(d % 2 == 0, "correction").otherwise("approval").alias("label"),
        F.when(d % 2 == 0, F.element_at(causes, ((d / 2) % 5 + 1).cast("int"))).alias("cause"),
    )
    return labels.select(
        F.concat(F.lit("s"), d.cast("string")).alias("sid"), (q * 3 + t * 2).alias("score"),
        F.when(t == 1, "partial").otherwise("completed").alias("outcome"),
        F.filter(items, lambda item: (F.length(item) + d) % 3 == 0).alias("missing"),
        F.array(turn).alias("turns"),
    )


def judged_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared sessions with machine, resume links (session 3u to 3u+1) and verdicts."""
    s = session_number()
    base = sessions(spark, sf_dir).drop("continued_in").withColumns(
        {
            "machine": F.concat(F.lit("m"), (F.floor(s / 3) % 3).cast("string")),
            "continued_in": F.when((s % 3 == 0) & (F.floor(s / 3) % 3 != 0), F.concat(F.lit("s"), (s + 1).cast("string"))),
        }
    )
    joined = S.attach_verdicts(S.link_resumes(base), verdicts(spark, sf_dir))
    return rules.prepare(joined)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "prepared", lambda: judged_sessions(spark, sf_dir))


def prices(spark: SparkSession) -> DataFrame:
    """A small price dimension with a dated-id case, an own cache price and an unlisted model."""
    rows = [("alpha-1", 5.0, 25.0, None), ("mini-haiku-2", 1.0, 5.0, 0.025)]
    return spark.createDataFrame(rows, "price_id string, p_in double, p_out double, own_cache_read double").withColumns(
        {
            "cache_write_5m": F.lit(1.25), "cache_write_1h": F.lit(2.0), "cache_read": F.lit(0.1), "fast_multiplier": F.lit(2.0),
        }
    )


