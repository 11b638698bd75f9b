"""Benchmark decontamination by winnowing, in built-in functions only.

A benchmark window is ``WINDOW`` consecutive words of an item (a shorter item is one window).  Every text is reduced to
fingerprints: the least hash of every ``WINDOW - GRAM + 1`` consecutive runs of ``GRAM`` words.  Any ``WINDOW`` words that two
texts share contain the same least hash, so no shared window is missed.  Documents are joined to the benchmark by
fingerprint; only documents with a common one are read again, and there every common run is extended word by word to the
windows around it, which makes the result exact.  Items shorter than a window are looked up whole, by their length.

Defined results: null or empty texts have no words and no hits; rows are told apart by id and text, and repeated rows get
equal results; a benchmark row without an id hits words but is not listed; without words it occurs nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import let, materialize, same_row

WINDOW, GRAM = 10, 5
_AROUND = WINDOW - GRAM  # a window can begin so many words before a run that it contains
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of ASCII digits, letters (A-Z lower-cased) and all characters beyond ASCII; null has none."""
    plain = F.octet_length(text) == F.length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.coalesce(F.filter(F.split(low, _BETWEEN), lambda w: w != ""), F.array().cast("array<string>"))


def grams(found: Column) -> Column:
    """A hash for every run of GRAM words; none in shorter texts."""
    at = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - GRAM), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(GRAM))))
    hashes = F.transform(found, lambda w: F.xxhash64(w))
    return F.when(F.size(found) >= GRAM, let(hashes, at)).otherwise(F.array().cast("array<long>"))


def prints(runs: Column) -> Column:
    """The distinct least hashes of every window's runs; texts shorter than a window have none."""
    span = WINDOW - GRAM + 1
    least = lambda g: F.transform(F.sequence(F.lit(0), F.size(g) - span), lambda i: F.least(*(F.get(g, i + j) for j in range(span))))
    return let(runs, lambda g: F.when(F.size(g) >= span, F.array_distinct(least(g))).otherwise(F.array().cast("array<long>")))


def _around(rows: DataFrame, names: list[str], wanted: str) -> DataFrame:
    """A row for every run whose hash is in the list ``wanted``: its hash, place, and the words around it."""
    places = let(
        F.col("runs"), lambda g: F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_contains(F.col(wanted), F.get(g, i)))
    )
    at = rows.where(F.size("runs") > 0).select(*names, "words", "runs", F.explode(places).alias("place"))
    before = F.least(F.col("place"), F.lit(_AROUND))
    return at.select(
        *names, "place", F.get("runs", F.col("place")).alias("run"), before.alias("before"),
        F.slice("words", F.col("place") - before + 1, before + WINDOW).alias("context"),
    )


def hit_spans(docs: DataFrame, benchmark: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """docs(id, text) and benchmark(item, text) to (id, hash, n_words) and the spans (id, hash, first, last, item)."""
    items = benchmark.select("item", words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    items = materialize(items, f"{name}_items")
    long_items = items.where(F.size("words") >= WINDOW).withColumn("runs", grams(F.col("words"))).withColumn("prints", prints(F.col("runs")))
    known = materialize(_around(long_items, ["item"], "prints"), f"{name}_item_runs")
    runs = materialize(known.select("run").distinct(), f"{name}_runs")

    found = docs.select("id", F.xxhash64("text").alias("hash"), words(F.col("text")).alias("words"))
    found = found.select("id", "hash", F.size("words").alias("n_words"), prints(grams(F.col("words"))).alias("prints"))
    found = materialize(found, f"{name}_prints")

    candidates = found.select("id", "hash", F.explode("prints").alias("run")).join(runs, "run", "left_semi")
    candidates = materialize(candidates.groupBy("id", "hash").agg(F.collect_set("run").alias("common")), f"{name}_candidates")
    again = docs.withColumn("hash", F.xxhash64("text"))
    again = again.join(candidates, same_row(again, candidates, ["id", "hash"])).select(again["id"], again["hash"], words(F.col("text")).alias("words"), "common")
    again = again.withColumn("runs", grams(F.col("words")))
    common = _around(again, ["id", "hash"], "common").alias("d").join(known.alias("b"), "run")

    def window(side: str, back: Column) -> Column:
        return F.slice(F.col(f"{side}.context"), F.col(f"{side}.before") - back + 1, WINDOW)

    backs = F.filter(
        F.sequence(F.lit(0), F.least("d.before", "b.before")),
        lambda back: (F.size(window("d", back)) == WINDOW) & (window("d", back) == window("b", back)),
    )
    spans = common.select("d.id", "d.hash", F.explode(F.transform(backs, lambda back: F.col("d.place") - back)).alias("first"), F.lit(WINDOW).alias("length"), "item")
    short = _short_spans(docs, items)
    spans = spans if short is None else spans.unionByName(short)
    return found.drop("prints"), spans.select("id", "hash", "first", (F.col("first") + F.col("length")).alias("last"), "item")


def _short_spans(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """Where items of fewer words than a window occur; their distinct lengths, nine at most, are looked up first."""
    short = items.where(F.size("words") < WINDOW).select("item", "words", F.size("words").alias("length"))
    lengths = [r[0] for r in short.select("length").distinct().collect()]
    if not lengths:
        return None
    text = docs.select("id", F.xxhash64("text").alias("hash"), words(F.col("text")).alias("words"))
    out = None
    for length in lengths:
        runs = text.where(F.size("words") >= length).select(
            "id", "hash",
            F.posexplode(let(F.col("words"), _runs_of(length))).alias("first", "run"),
        )
        wanted = short.where(F.col("length") == length).select("item", "length", F.array_join("words", " ").alias("joined"))
        hits = runs.withColumn("joined", F.array_join("run", " ")).join(wanted, "joined").select("id", "hash", "first", "length", "item")
        out = hits if out is None else out.unionByName(hits)
    return out


def _runs_of(length: int):
    return lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - length + 1), lambda i: F.slice(w, i, length))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", name: str = "decontaminate") -> DataFrame:
    """For every row: id, hash of its text, n_words, n_hit words, the sorted ids (as text) of the items found in it."""
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    benchmark = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").alias("text"))
    found, spans = hit_spans(docs, benchmark, name)
    grouped = spans.groupBy("id", "hash").agg(
        F.collect_set(F.struct("first", "last")).alias("spans"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")
    )
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], s["last"]).alias("upto")
        ),
        lambda acc: acc["n"],
    )
    hits = materialize(grouped.select("id", "hash", covered.alias("n_hit"), "items"), f"{name}_hits")
    joined = found.join(hits, same_row(found, hits, ["id", "hash"]), "left")
    return joined.select(
        found["id"], found["hash"], F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def without_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "without_hits") -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs."""
    found = contamination(docs, benchmark, id_col, text_col, name=name)
    bad = materialize(found.where("n_hit > 0").select(F.col("id").alias("__id"), F.col("hash").alias("__hash")).distinct(), f"{name}_bad")
    match = docs[id_col].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[text_col]) == bad["__hash"])
    return docs.join(bad, match, "left_anti")
