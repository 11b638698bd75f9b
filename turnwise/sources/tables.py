"""Other inputs: prices, live registry, deny list, verdicts, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise import fixed, schemas


def read_price_list(spark: SparkSession, path: str) -> DataFrame:
    """One row per listed model id, with the list's multipliers on every row."""
    schema = (
        "cache_write_5m DOUBLE, cache_write_1h DOUBLE, cache_read DOUBLE, fast_multiplier DOUBLE, "
        "models MAP<STRING, STRUCT<`in`: DOUBLE, out: DOUBLE, window: BIGINT, cache_read: DOUBLE>>"
    )
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    defaults = {
        "cache_write_5m": fixed.CACHE_WRITE_5M, "cache_write_1h": fixed.CACHE_WRITE_1H, "cache_read": fixed.CACHE_READ,
        "fast_multiplier": fixed.FAST_MULTIPLIER,
    }
    return raw.fillna(defaults).select(*defaults, F.explode("models").alias("price_id", "m")).select(
        "price_id", F.col("m.in").alias("p_in"), F.col("m.out").alias("p_out"), F.col("m.window").alias("window"),
        F.col("m.cache_read").alias("own_cache_read"), *defaults,
    )


def read_live_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The registry of sessions running now; which processes live is decided outside."""
    return spark.read.schema(schemas.LIVE).option("multiLine", "true").json(path).filter("sessionId != ''")


def deny_list_from_env_lines(lines: DataFrame) -> DataFrame:
    """Secret values (column ``value``) from ``KEY=value`` lines."""
    line = F.trim("value")
    kept = lines.filter(~line.startswith("#") & F.contains(line, F.lit("=")))
    bare = F.trim(F.expr("substring(trim(value), instr(trim(value), '=') + 1)"))
    for quote in ('"', "'"):
        bare = F.regexp_replace(bare, f"^{quote}+|{quote}+$", "")
    return kept.select(bare.alias("value")).filter(F.length("value") >= fixed.DENY_MIN_CHARS).distinct()


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Verdict store file (session id to entry); entries without a result are left out."""
    result = "STRUCT<n_turns: BIGINT, turns: ARRAY<STRUCT<i: BIGINT, label: STRING, cause: STRING>>, " \
        "first_prompt: STRUCT<goal: BOOLEAN, context: BOOLEAN, constraints: BOOLEAN, done_criterion: BOOLEAN, scope: BOOLEAN>, " \
        "score: BIGINT, missing: ARRAY<STRING>, outcome: STRING, summary: STRING, judged_by: STRING>"
    entry = f"MAP<STRING, STRUCT<n_turns: BIGINT, at: STRING, attempts: BIGINT, judged_by: STRING, result: {result}>>"
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", entry)).alias("sid", "e"))
    return entries.filter("e.result is not null").select(
        "sid", "e.result.*", F.coalesce("e.judged_by", "e.result.judged_by").alias("by"), F.col("e.at").alias("judged_at")
    ).drop("judged_by").withColumnRenamed("by", "judged_by")


def read_newest_note(spark: SparkSession, path: str) -> DataFrame:
    """The coach note whose file name is last; the name is its date."""
    notes = spark.read.schema("judged_total BIGINT, notes ARRAY<STRUCT<pattern: STRING, advice: STRING, prompt_shape: STRING>>").option(
        "multiLine", "true"
    ).json(path).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)\\.json$", 1).alias("date"), "judged_total", "notes")
    return notes.agg(F.max_by(F.struct("date", "judged_total", "notes"), "date").alias("n")).filter("n is not null").select("n.*")
