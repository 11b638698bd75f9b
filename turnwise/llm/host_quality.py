"""Host-level quality rules, in built-in functions only.

Every text is measured in place.  The rows that fail a rule are counted per host, and each host's failure rate is shrunk towards
the rates of all hosts: the counts follow a beta prior fitted to the hosts by the method of moments, so a host of few rows
is not judged by them alone.  A host whose shrunk rate is beyond ``MOST_FAILED`` is rejected with all its rows; rows that fail
go in any case.  Host counts are summed before they are shuffled, and verdicts (one narrow row a host) are joined back to
the measures, never to the texts.

Defined results: a null text has no words and fails; a null host is a host of its own; repeated rows are measured and
counted each; a table without rows has no verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import SPACES, let, materialize

LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words in windows that occur twice or more
REPEAT_WIDTH = 3
SYMBOLS = "#*$%&|<>"
MOST_FAILED = 0.6  # shrunk share of failing rows from which a host is rejected


def words(text: Column) -> Column:
    return F.coalesce(F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != ""), F.array().cast("array<string>"))


def without(text: Column, chars: str) -> Column:
    return F.coalesce(F.length(F.translate(text, chars, "")), F.lit(0))


def repeated_words(found: Column, width: int = REPEAT_WIDTH) -> Column:
    """Words inside windows of ``width`` words that occur twice or more.

    Windows are hashed and sorted as (hash, place); a window next to one of the same hash is repeated.  The places
    of repeated windows, in order, then cover ``width`` words each, less what the next one covers.
    """
    hashes = F.transform(found, lambda w: F.xxhash64(w))
    keyed = let(
        hashes,
        lambda h: F.sort_array(F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.struct(F.xxhash64(*(F.get(h, i + j) for j in range(width))).alias("run"), i.alias("place")))),
    )
    run = lambda s, i: F.get(s, i)["run"]
    places = let(
        keyed, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: (x["run"] == run(s, i + 1)) | (x["run"] == F.when(i > 0, run(s, i - 1)))), lambda x: x["place"]))
    )
    covered = let(
        places,
        lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))), F.lit(0), lambda a, x: a + x
        ),
    )
    return F.when(F.size(found) >= width, covered).otherwise(0)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every row."""
    text = F.col(f"`{text_col}`")
    size = F.coalesce(F.length(text), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{host_col}`").cast("string").alias("host"), words(text).alias("words"),
        without(text, SPACES).cast("long").alias("word_chars"),
        (size - without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        F.coalesce(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long").alias("n_dup_lines"),
    )
    rows = rows.select(
        "id", "host", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def host_verdicts(measured: DataFrame, most_failed: float = MOST_FAILED) -> DataFrame:
    """(host, n_rows, n_failed, shrunk_rate, host_rejected), a null host included."""
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    alpha, beta = beta_prior(hosts)
    rate = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_rows") + F.lit(alpha + beta))
    return hosts.withColumn("shrunk_rate", rate).withColumn("host_rejected", rate > most_failed)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Parameters of the beta prior from hosts(n_rows, n_failed), by moments.

    The spread of the hosts' rates less what binomial chance gives is the prior's variance.  Where no spread is left, the
    prior is as strong as all rows together.
    """
    rate = F.col("n_failed") / F.col("n_rows")
    got = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n_rows").alias("rows"), F.sum("n_failed").alias("failed"), F.avg(rate).alias("mean"),
        F.avg(rate * rate).alias("square"), F.avg(1 / F.col("n_rows")).alias("inverse"),
    ).first()
    if not got.hosts:
        return 0.5, 0.5
    mean = min(max(got.failed / got.rows, 1e-6), 1 - 1e-6)
    chance = mean * (1 - mean) * got.inverse
    spread = got.square - 2 * mean * got.mean + mean * mean - chance
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), float(got.rows)) if spread > 0 else float(got.rows)
    return mean * strength, (1 - mean) * strength


def judged(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The measures of every row with its host's verdict and whether it is kept."""
    measured = materialize(measures(docs, id_col, text_col, host_col), f"{name}_measures")
    hosts = materialize(host_verdicts(measured), f"{name}_hosts").withColumnRenamed("host", "__host")
    joined = measured.join(hosts, measured["host"].eqNullSafe(hosts["__host"]), "left")
    return joined.drop("__host").withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
