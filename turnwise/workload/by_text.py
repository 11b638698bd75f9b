"""Queries over the text tables: documents, conversations, pages, benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise import fixed
from turnwise.functions import formats, redact, text as X
from turnwise.operators import ordered, records as R, review
from turnwise.operators.ordering import first_by
from turnwise.operators.progress import project_root
from turnwise.session import materialize, spread
from turnwise.workload.adapter import load
from turnwise.workload.silver import once

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_trim(e: str) -> str:
    return f"regexp_replace({e}, {sql_text('^' + X.SPACE + '+|' + X.SPACE + '+$')}, '', 'g')"


def sql_collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, {sql_text(X.SPACE + '+')}, ' ', 'g'))"


def sql_match(e: str, pattern: str) -> str:
    return f"regexp_matches({e}, {sql_text(pattern)})"


def _runs_sql(table: str, key: str, turn: str, n: int, where: str = "true") -> str:
    return (
        f"w AS (SELECT {key} AS k, {turn} AS t, string_split({sql_collapse('lower(text)')}, ' ') AS w FROM {table} WHERE {where}), "
        f"runs AS (SELECT DISTINCT k, t, array_to_string(w[i:i + {n - 1}], ' ') AS run FROM (SELECT k, t, w, unnest(range(1, len(w) - {n - 2})) AS i FROM w)), "
        "firsts AS (SELECT k, run, min(t) AS first_t FROM runs GROUP BY k, run), "
        "rep AS (SELECT DISTINCT runs.k, runs.t FROM runs JOIN firsts USING (k, run) WHERE first_t < runs.t)"
    )


@query(
    "repeated_wording",
    f"WITH {_runs_sql('documents', 'source', 'doc_id', 6)} SELECT w.k AS source, w.t AS doc_id, rep.t IS NOT NULL AS repeated FROM w LEFT JOIN rep USING (k, t)",
)
def repeated_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents").select("source", "doc_id", "text"))
    return ordered.repeated_wording(docs, ["source"], "doc_id", "text")


@query(
    "repeated_wording_conv",
    f"WITH {_runs_sql('conversations', 'conv_id', 'turn', 2)} SELECT w.k AS conv_id, w.t AS turn, rep.t IS NOT NULL AS repeated FROM w LEFT JOIN rep USING (k, t)",
)
def repeated_wording_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return ordered.repeated_wording(turns, ["conv_id"], "turn", "text", n=2)


_T = sql_trim("text")
_FEATURES_SQL = f"""CASE WHEN {sql_collapse('text')} = '' THEN 0 ELSE len(string_split({sql_collapse('text')}, ' ')) END AS fp_words,
  {sql_match(_T, X.PATTERNS['has_path'])} AS has_path, {sql_match(_T, X.PATTERNS['has_constraint'])} AS has_constraint,
  {sql_match(_T, X.PATTERNS['has_done_criterion'])} AS has_done_criterion,
  ends_with({_T}, '?') OR {sql_match(_T, X.PATTERNS['question'])} AS is_question, starts_with({_T}, '/') AS slash_cmd,
  {sql_match(_T, X.PATTERNS['mentions_plan'])} AS mentions_plan"""


@query("prompt_features", f"SELECT doc_id, {_FEATURES_SQL} FROM documents")
def prompt_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents"))
    return docs.select("doc_id", *[c.alias(n) for n, c in X.first_prompt_features(F.col("text")).items()])


@query(
    "first_prompt_features",
    f"SELECT conv_id, {_FEATURES_SQL} FROM (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id)",
)
def first_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")
    first = first_by(turns, ["conv_id"], F.col("turn"))
    return first.select("conv_id", *[c.alias(n) for n, c in X.first_prompt_features(F.col("text")).items()])


_LEXICON = ("the", "is", "et", "la", "der", "und", "el", "es", "que", "of")
_NOT_LEXICON = ("the of", "la de")


@query(
    "opening_lexicon",
    f"""SELECT conv_id, turn, turn > 1 AND {sql_match(_T, X.opening_pattern(_LEXICON))}
      AND NOT {sql_match(_T, X.opening_pattern(_NOT_LEXICON))} AS reads_as_correction FROM conversations""",
)
def opening_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    hit = X.opens_like_correction(F.col("text"), F.col("turn"), _LEXICON, _NOT_LEXICON)
    return turns.select("conv_id", "turn", hit.alias("reads_as_correction"))


def sql_redact(e: str, patterns) -> str:
    for p in patterns:
        e = f"regexp_replace({e}, {sql_text(p)}, '{fixed.REDACTED}', 'g')"
    return e


_EXTRA = (*fixed.SECRET_PATTERNS, r"[0-9a-f]{24,}", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z]")


@query(
    "redact_documents",
    f"SELECT doc_id, md5({sql_redact('text', _EXTRA)}) AS digest, {sql_redact('text', _EXTRA)} <> text AS changed FROM documents",
)
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents"))
    clean = redact.redact(F.col("text"), _EXTRA)
    return docs.select("doc_id", F.md5(clean.cast("binary")).alias("digest"), (clean != F.col("text")).alias("changed"))


_VALUE = "[0-9a-f]{16,}"


def _listed_sql(table: str, keys: str) -> str:
    """Every listed value inside every text, longest first, by nested search."""
    return f"""WITH deny AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_VALUE}')) AS v FROM documents),
    texts AS (SELECT DISTINCT text FROM {table}),
    found AS (SELECT text, list(v ORDER BY length(v) DESC, v) AS vs FROM texts JOIN deny ON contains(text, v) GROUP BY text)
    SELECT {keys}, md5(CASE WHEN vs IS NULL THEN d.text ELSE list_reduce(list_prepend(d.text, vs), lambda a, v: replace(a, v, '{fixed.REDACTED}')) END) AS digest,
      vs IS NOT NULL AS changed FROM {table} d LEFT JOIN found USING (text)"""


def _redact_listed(spark: SparkSession, sf_dir: str, table: str, *keys: str) -> DataFrame:
    """The deny list is every value that any document holds."""
    docs = load(spark, sf_dir, "documents").select("text")
    deny = spread(docs).select(F.explode(F.regexp_extract_all("text", F.lit(_VALUE), F.lit(0))).alias("value")).distinct()
    rows = spread(load(spark, sf_dir, table).select(*keys, "text"))
    out = redact.redact_listed(rows.withColumn("before", F.col("text")), "text", materialize(deny, "deny_list"))
    return out.select(*keys, F.md5(F.col("text").cast("binary")).alias("digest"), (F.col("text") != F.col("before")).alias("changed"))


@query("redact_listed", _listed_sql("documents", "doc_id"))
def redact_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redact_listed(spark, sf_dir, "documents", "doc_id")


@query("redact_listed_join", _listed_sql("conversations", "conv_id, turn"))
def redact_listed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' values looked for in another table."""
    return _redact_listed(spark, sf_dir, "conversations", "conv_id", "turn")


def sql_strip(e: str) -> str:
    e = f"regexp_replace({e}, '(?s)<{fixed.REMINDER_TAG}>.*?</{fixed.REMINDER_TAG}>', ' ', 'g')"
    return e


def sql_clean(e: str) -> str:
    return sql_redact(sql_collapse(sql_strip(e)), fixed.SECRET_PATTERNS)


@query(
    "clean_text",
    f"""SELECT 'doc' AS kind, doc_id AS id, md5({sql_clean('text')}) AS digest FROM documents
        UNION ALL SELECT 'page', page_id, md5({sql_clean('html')}) FROM pages""",
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = load(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    both = spread(docs.unionByName(pages))
    return both.select("kind", "id", F.md5(review.clean_text(F.col("text")).cast("binary")).alias("digest"))


@query(
    "fingerprint",
    f"SELECT doc_id, substring(sha1({sql_collapse('lower(text)')}), 1, 12) AS fp FROM documents",
)
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "documents")).select("doc_id", X.fingerprint(F.col("text")).alias("fp"))


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as transcript lines (user turns plain text, replies as blocks), parsed."""
    turns = load(spark, sf_dir, "conversations")
    plain = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    reply = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(block.alias("content")).alias("message")))
    other = F.to_json(F.struct(F.lit("system").alias("type"), F.lit("note").alias("subtype")))
    value = F.when(F.col("role") == "user", plain).when(F.col("role") == "assistant", reply).otherwise(other)
    lines = spread(turns).select(F.format_string("/c/%d.jsonl", "conv_id").alias("path"), F.col("turn").alias("line_no"), value.alias("value"))
    return once(spark, sf_dir, "conversation_records", lambda: R.read_records(lines))


@query(
    "turn_digest",
    f"""WITH c AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' AND {sql_trim('text')} <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    u AS (SELECT conv_id, i, {sql_clean('text')} AS you FROM c WHERE role = 'user' AND {sql_trim('text')} <> ''),
    s AS (SELECT conv_id, i, arg_max({sql_collapse('text')}, turn) AS said FROM c WHERE role = 'assistant' GROUP BY conv_id, i)
    SELECT conv_id, CAST(i AS BIGINT) AS i, md5(you) AS you, md5(coalesce(said, '')) AS said, 0::BIGINT AS omitted FROM u LEFT JOIN s USING (conv_id, i)""",
)
def turn_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = review.build_digests(conversation_records(spark, sf_dir))
    return digests.select(
        F.regexp_extract("path", "([0-9]+)\\.jsonl", 1).cast("bigint").alias("conv_id"), "omitted_earlier_turns", F.explode("turns").alias("t")
    ).select(
        "conv_id", "t.i", F.md5(F.col("t.you").cast("binary")).alias("you"), F.md5(F.col("t.said").cast("binary")).alias("said"),
        F.col("omitted_earlier_turns").cast("bigint").alias("omitted"),
    )


@query(
    "quote_check",
    f"""WITH {_runs_sql('documents', '0', 'doc_id', 6)},
    b AS (SELECT item_id, string_split({sql_collapse('lower(text)')}, ' ') AS w FROM benchmark),
    br AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 5], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 4)) AS i FROM b))
    SELECT benchmark.item_id, count(firsts.run) AS shared_runs FROM benchmark LEFT JOIN br USING (item_id) LEFT JOIN firsts USING (run) GROUP BY benchmark.item_id""",
)
def quote_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(load(spark, sf_dir, "documents").select("text"))
    return review.quoted_items(load(spark, sf_dir, "benchmark"), docs, "item_id")


@query(
    "size_labels",
    """SELECT doc_id, CASE WHEN n >= 1000000 THEN printf('%.1f MB', n / 1e6::DOUBLE) WHEN n >= 1000 THEN CAST(floor(n / 1e3::DOUBLE + 0.5) AS BIGINT) || ' KB' ELSE n || ' B' END AS bytes,
      CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1e6::DOUBLE) WHEN n >= 1000 THEN CAST(floor(n / 1e3::DOUBLE + 0.5) AS BIGINT) || 'K' ELSE CAST(n AS VARCHAR) END AS tokens,
      CASE WHEN n < 90 THEN n || 's' WHEN n < 5400 THEN CAST(floor(n / 60.0::DOUBLE + 0.5) AS BIGINT) || 'm'
        WHEN n < 36000 THEN printf('%.1fh', n / 3600.0::DOUBLE) WHEN n < 172800 THEN printf('%.0fh', n / 3600.0::DOUBLE) ELSE CAST(floor(n / 86400.0::DOUBLE + 0.5) AS BIGINT) || 'd' END AS span
      FROM (SELECT doc_id, n_chars AS n FROM documents)""",
)
def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    span = formats.duration(n.cast("double"))
    return load(spark, sf_dir, "documents").select(
        "doc_id", formats.byte_size(n).alias("bytes"), formats.tokens(n).alias("tokens"), span.alias("span")
    )


@query(
    "project_root",
    """WITH p AS (SELECT DISTINCT rtrim(regexp_replace(regexp_replace(url, '^https?:/', ''), '[?#].*$', ''), '/') AS cwd FROM pages),
    roots AS (SELECT DISTINCT regexp_extract(cwd, '^/[^/]+/[^/]+') AS root FROM p WHERE cwd LIKE '/%/%/%')
    SELECT cwd, coalesce((SELECT arg_max(root, length(root)) FROM roots WHERE root <> '' AND (cwd = root OR starts_with(cwd, root || '/'))), cwd) AS root FROM p WHERE cwd <> ''""",
)
def project_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?:/", ""), "[?#].*$", ""), "/+$", "")
    cwds = load(spark, sf_dir, "pages").select(path.alias("cwd"))
    roots = cwds.filter("cwd like '/%/%/%'").select(F.regexp_extract("cwd", "^/[^/]+/[^/]+", 0).alias("root")).filter("root <> ''")
    return project_root(cwds, roots, "/home/nobody")
