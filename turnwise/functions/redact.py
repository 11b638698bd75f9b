"""Secret redaction: key patterns and exact deny-listed values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise import fixed

_GRAM = 8  # characters of a hashed run; any DENY_MIN_CHARS characters hold DENY_MIN_CHARS - _GRAM + 1 of them


def redact(text: Column, patterns: Sequence[str] = fixed.SECRET_PATTERNS) -> Column:
    """Replace every key-shaped run; stays inside whole-stage codegen."""
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, fixed.REDACTED)
    return text


def redact_columns(df: DataFrame, cols: Sequence[str], patterns: Sequence[str] = fixed.SECRET_PATTERNS) -> DataFrame:
    """Redact only the columns that can hold free text."""
    return df.withColumns({c: redact(F.col(c), patterns) for c in cols})


def _replace_values(text: Column, values: Column) -> Column:
    return F.aggregate(values, text, lambda acc, v: F.replace(acc, v, F.lit(fixed.REDACTED)))


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _marks(text: Column) -> Column:
    """The distinct least run hashes of every ``DENY_MIN_CHARS`` characters of a text.

    Equal stretches of that length have equal marks, so a text that holds a
    listed value holds the mark of the value's beginning.  Neighbouring
    stretches mostly share theirs: there is about one mark for five characters.
    """
    span = fixed.DENY_MIN_CHARS - _GRAM + 1

    def runs(chars: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(chars) - _GRAM), lambda i: F.xxhash64(*(F.get(chars, i + j) for j in range(_GRAM))))

    def least(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - span), lambda i: F.least(*(F.get(hashes, i + j) for j in range(span))))

    found = _let(F.split(text, ""), lambda chars: _let(runs(chars), lambda hashes: F.array_distinct(least(hashes))))
    return F.when(F.length(text) >= fixed.DENY_MIN_CHARS, found).otherwise(F.array().cast("array<bigint>"))


def redact_listed(df: DataFrame, col: str, deny: DataFrame) -> DataFrame:
    """Replace every deny-listed value (column ``value`` of ``deny``) inside ``col``.

    One form for every length of list and text.  What a text becomes depends on
    the text alone, so rows are known by their text: ids may be null or
    repeated.  Texts and values meet by their marks (see ``_marks``), which are
    filtered by the list's marks before anything else moves; a possible hit is
    confirmed with ``contains``.  Longer values are replaced first.  Values
    shorter than ``DENY_MIN_CHARS`` are not looked for; null texts stay null.
    """
    key = [F.xxhash64(col).alias("__a"), F.crc32(F.col(col).cast("binary")).alias("__b"), F.length(col).alias("__c")]
    names = ["__a", "__b", "__c"]
    listed = deny.select("value").where(F.length("value") >= fixed.DENY_MIN_CHARS).distinct()
    listed = listed.select("value", F.get(_marks(F.substring("value", 1, fixed.DENY_MIN_CHARS)), F.lit(0)).alias("__mark"))
    texts = df.where(F.col(col).isNotNull()).select(F.col(col).alias("__text"), *key)
    marks = texts.select(*names, F.explode(_marks(F.col("__text"))).alias("__mark"))
    possible = marks.join(listed, "__mark").select(*names, "value").distinct()
    confirmed = possible.join(texts, names).where(F.contains("__text", "value")).groupBy(*names).agg(F.collect_set("value").alias("__found"))
    longest_first = F.transform(F.array_sort(F.transform("__found", lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda s: s["v"])
    keyed = df.select("*", *key)
    out = F.when(F.col("__found").isNull(), F.col(col)).otherwise(_replace_values(F.col(col), longest_first))
    return keyed.join(confirmed, names, "left").withColumn(col, out).select(*df.columns)
