"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of key characters that has a digit and is long, or whatever without spaces is assigned to a name that ends in
a word such as ``password``, or stands for the password in a URL; a key of a published format inside of one is a candidate of its own.  Each is
described by numbers: its length, its character classes and the transitions between them, how likely its letter pairs are in
ordinary words, how much of it a dictionary covers, its entropy, whether it lies in a path, URL or address, what the document's own
path says, and the words next to it (a few known ones, the others hashed).

The dictionary is the ``DICTIONARY_WORDS`` most frequent words of all documents, counted in Spark.  The forest (Spark ML) is
fitted on at most about ``TRAIN_FINDINGS`` labelled findings, half of either label, drawn by hash, of documents outside the held-out
part.  Findings labelled by hand are given as a table (id, start, label); without one, findings of exact published formats are taken
as true, those of a known harmless kind (addresses, numbers and dates, paths, a word of prose after a colon) as false, and the forest
learns from no others.

Defined results: null and empty texts have no candidates; repeated rows give their findings each; a null id is
never learnt from; with labels of one kind only, every score is that label.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import arrow_rows, hold, materialize, md5_unit
from turnwise.llm.toxicity import held_out

DICTIONARY_WORDS = 20_000
TRAIN_FINDINGS = 50_000
TREES, DEPTH = 30, 8
LEAST_LENGTH, LEAST_ASSIGNED = 16, 8
NEIGHBOURS, WORD_BINS = 3, 16

#: Names to which secrets are assigned, and words that mark examples. Fixed values.
NAMES = "password passwd pwd secret token apikey api_key api-key access_key auth credential credentials private_key bearer key".split()
EXAMPLES = "example sample test tests mock fixture fixtures dummy placeholder demo docs doc changeme xxxx".split()
#: Published formats of keys. Fixed values.
FORMATS = {
    "access_key_id": re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}"),
    "assigned_hex": re.compile(r"[0-9a-f]{18}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}"),
    "prefixed": re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24,}|xox[abpr]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)"),
}

_CANDIDATE = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_=.@:-]*")
_SEPARATOR = re.compile(r"(?:=>|=|:)\s*")
_NAMED = re.compile(r"[A-Za-z0-9_.-]*(?:" + "|".join(sorted(map(re.escape, NAMES), key=len, reverse=True)) + r")(?:[_-]?id)?[\"']?\s*$", re.IGNORECASE)
_VALUE = re.compile(r"\"[^\"\s]+(?=\")|'[^'\s]+(?=')|[\"']?([^\s\"']\S*)")
_USERINFO = re.compile(r"://[^\s/:@]*:([^\s/]+)@")
_INSIDE = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(FORMATS[k].pattern for k in ("access_key_id", "prefixed")) + r")(?![A-Za-z0-9])")
_HEX_FIRST = re.compile(r"(?:" + FORMATS["assigned_hex"].pattern + r")(?=[&;,\"'])")
_HARMLESS = re.compile(
    r"[0-9][0-9.:+/_TZ-]*"  # numbers, dates, times
    r"|[^@\s:/]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"  # mail addresses
    r"|[A-Za-z]+://[^?@\s]*"  # web addresses without a password or query
    r"|(?:[a-z]+[a-z0-9._-]{0,23}/){2,}[a-z0-9._-]{0,24}"  # paths
)
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = re.compile(r"[A-Za-z]+")

CANDIDATE = "id {kind}, start long, size long, digest string, format string, features array<double>, harmless boolean"


# ---------------------------------------------------------------- dictionary

def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words of 3 to 20 letters, summed within the task as far as memory allows."""
    hold("secret_scan", int)
    found: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
        found.clear()
        return out

    for batch in arrow_rows(batches):
        for body in batch.column("body").to_pylist():
            found.update(w for w in _LETTERS.findall((body or b"").decode("utf-8", "replace").lower()) if 3 <= len(w) <= 20)
        if len(found) > 300_000:
            yield rows()
    yield rows()


def dictionary(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY_WORDS) -> frozenset[str]:
    """The most frequent words of all documents, equal counts in alphabetical order."""
    rows = docs.select(F.col(f"`{text_col}`").cast("binary").alias("body")).mapInArrow(_words, "word string, n long")
    top = rows.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)
    return frozenset(r.word for r in top.collect())


class Describer:
    """Features of candidates under a dictionary."""

    def __init__(self, words: frozenset[str]):
        self.words = words
        self.longest = max(map(len, words), default=0)
        pairs = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
        firsts = Counter(w[0] for w in words for w in w[:-1])
        self.pairs = {p: math.log((n + 0.5) / (firsts[p[0]] + 13)) for p, n in pairs.items()}

    def covered(self, run: str) -> int:
        """Letters of a run that dictionary words, side by side or apart, can cover at most."""
        best = [0] * (len(run) + 1)
        for end in range(1, len(run) + 1):
            best[end] = best[end - 1]
            for size in range(3, min(self.longest, end) + 1):
                if run[end - size : end] in self.words and best[end - size] + size > best[end]:
                    best[end] = best[end - size] + size
        return best[-1]

    def describe(self, value: str, before: str, after: str, path: str, assigned: bool) -> list[float]:
        size = len(value)
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
        share = {k: kinds.count(k) / size for k in "dulo"}
        changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, size - 1)
        runs = _LETTERS.findall(value.lower())
        letters = sum(map(len, runs))
        pairs = [r[i : i + 2] for r in runs for i in range(len(r) - 1)]
        likely = sum(self.pairs.get(p, -6.0) for p in pairs) / max(1, len(pairs)) if pairs else -6.0
        counts = Counter(value)
        entropy = -sum(n / size * math.log2(n / size) for n in counts.values())
        left, right = _WORD.findall(before.lower())[-NEIGHBOURS:], _WORD.findall(after.lower())[:NEIGHBOURS]
        near = [*left, *right]
        bins = [0.0] * WORD_BINS
        for w in near:
            bins[xxhash.xxh3_64_intdigest(w.encode()) % WORD_BINS] += 1
        parts = set(re.split(r"[^a-z0-9]+", path.lower()))
        return [
            float(size), share["d"], share["u"], share["l"], share["o"], changes, likely, sum(map(self.covered, runs)) / size if letters else 0.0, entropy,
            float(all(c in "0123456789abcdefABCDEF" for c in value)), float(value.isdigit()), float(assigned), float("/" in value or "://" in before[-12:]),
            float("@" in value or before.endswith("@")), float(value.count(".") > 1 or value.count("-") > 3), float(any(w in EXAMPLES for w in near)),
            float(any(w in NAMES for w in near)), float(bool(parts & set(EXAMPLES))), float(path.endswith((".env", ".pem", ".cfg", ".ini", ".yml", ".yaml", ".json", ".properties"))), *bins,
        ]

    @staticmethod
    def assigned(text: str) -> list[tuple[int, int, int, bool]]:
        """(beginning of the name, start, end, prose) of each value that is assigned to a name or is the password of a URL, in order.

        ``prose`` says that it follows a colon and a space without quotes.
        """
        found: list[tuple[int, int, int, bool]] = []
        for m in _SEPARATOR.finditer(text):
            begin = max(0, m.start() - 64)
            name = _NAMED.search(text, begin, m.start())
            value = name and _VALUE.match(text, m.end())
            if not value:
                continue
            bare = value[1] is not None
            start, end = (value.start(1), value.end(1)) if bare else (value.start() + 1, value.end())
            if bare:
                held = text[start:end].rstrip(".,;:)]}>\"'")
                if held[:1] in tuple("([{<") and len(held) < end - start:
                    start, held = start + 1, held[1:]
                end = start + len(held)
            found.append((name.start(), start, end, bare and value.start(1) == value.start() and m[0][0] == ":" and m[0] != ":"))
        found += [(m.start(1), *m.span(1), False) for m in _USERINFO.finditer(text)]
        if not found:
            return []
        found.sort()
        # A value ends where the name of the next one begins.
        ends = [min(e, following[0]) if following[0] >= s else e for (_, s, e, _), following in zip(found, [*found[1:], (len(text), 0, 0, False)], strict=True)]
        return [(b, s, s + len(text[s:e].rstrip("&;,?") if e < old else text[s:e]), prose) for (b, s, old, prose), e in zip(found, ends, strict=True) if e > s]

    def candidates(self, text: str, path: str) -> Iterator[tuple[int, int, str, str | None, list[float], bool]]:
        """(start, length, digest, format, features, harmless) of each candidate; places are in code points."""
        values = self.assigned(text)
        parts = [(s, e, True, prose) for _, s, e, prose in values]
        taken = [(b, max(s, e)) for b, s, e, _ in values if e - s >= LEAST_ASSIGNED]
        at = 0
        for m in _CANDIDATE.finditer(text):
            start = m.start()
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            for begin, end in taken[at:]:
                if begin >= m.end():
                    break
                parts.append((start, max(start, begin), False, False))
                start = max(start, end)
            parts.append((start, max(start, m.end()), False, False))
        for start, end, assigned, prose in sorted(parts):
            yield from self._within(text, start, end, path, assigned, prose)

    def _within(self, text: str, start: int, end: int, path: str, assigned: bool, prose: bool) -> Iterator[tuple[int, int, str, str | None, list[float], bool]]:
        """The candidates of one part of a text: keys of published formats inside of it, and what is left around them."""
        if end - start < (LEAST_ASSIGNED if assigned else LEAST_LENGTH):
            return
        value = text[start:end]
        if not assigned:
            left = value.lstrip("+/_=.@:-")
            start, value = end - len(left), left.rstrip(".:=-/")
        found = _INSIDE.search(value) or (assigned and _HEX_FIRST.match(value))
        if found and len(found[0]) < len(value):
            first, last = start + found.start(), start + found.end()
            yield from self._within(text, start, first, path, False, False)
            yield from self._within(text, first, last, path, assigned, False)
            yield from self._within(text, last, start + len(value), path, False, False)
            return
        if len(value) < (LEAST_ASSIGNED if assigned else LEAST_LENGTH) or not (assigned or any(c.isdigit() for c in value)):
            return
        form = next((k for k, p in FORMATS.items() if p.fullmatch(value) and (assigned or k != "assigned_hex")), None)
        end = start + len(value)
        harmless = form is None and (value.lower() in self.words if assigned and prose else not assigned and bool(_HARMLESS.fullmatch(value)))
        features = self.describe(value, text[max(0, start - 60) : start], text[end : end + 60], path, assigned)
        yield start, len(value), hashlib.sha256(value.encode()).hexdigest(), form, features, harmless


def _scan(words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describer = Describer(words.value)
        for batch in arrow_rows(batches):
            at, rows = [], []
            for i, (body, path) in enumerate(zip(batch.column("body").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                for found in describer.candidates((body or b"").decode("utf-8", "replace"), path or ""):
                    at.append(i)
                    rows.append(found)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.bool_()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["id", "start", "size", "digest", "format", "features", "harmless"],
            )

    return run


def candidates(docs: DataFrame, words: frozenset[str], id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(id, start, size, digest, format, features, harmless) of every candidate, in one pass without a shuffle.

    The value itself is not carried along, only its SHA-256.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)
    path = F.col(f"`{path_col}`").cast("string") if path_col else F.lit("")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), path.alias("path"), F.col(f"`{text_col}`").cast("binary").alias("body"))
    return rows.mapInArrow(_scan(shared), CANDIDATE.format(kind=dict(docs.dtypes)[id_col]))


# ---------------------------------------------------------------- forest

def fit(found: DataFrame, findings: DataFrame | None = None, seed: int = 17) -> RandomForestClassificationModel | float:
    """A forest from labelled findings(id, start, label), or from formats; the only label there is, where it is one."""
    learn = found.where(~held_out(F.col("id")))
    if findings is None:
        labelled = learn.withColumn("label", F.when(F.col("format").isNotNull(), 1.0).when(F.col("harmless"), 0.0)).where("label is not null")
    else:
        known = findings.groupBy("id", "start").agg(F.max("label").cast("double").alias("label")).where("label is not null")
        labelled = learn.join(known, ["id", "start"])
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return next(iter(counts), 0.0)
    rate = F.lit(0.0)
    for label, n in counts.items():
        rate = F.when(F.col("label") == label, min(1.0, TRAIN_FINDINGS / 2 / n)).otherwise(rate)
    sample = labelled.where(md5_unit(F.col("id"), F.col("start"), F.lit("train")) < rate)
    rows = sample.select("label", array_to_vector("features").alias("features"))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def score(found: DataFrame, model: RandomForestClassificationModel | float) -> DataFrame:
    """The candidates with ``score``, the forest's share of votes for a secret."""
    if isinstance(model, float):
        return found.withColumn("score", F.lit(model))
    scored = model.transform(found.withColumn("__vector", array_to_vector("features")).withColumnRenamed("features", "__features").withColumnRenamed("__vector", "features"))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("__features", "features")


def scan(docs: DataFrame, name: str, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(id, start, size, digest, format, score, secret) of every candidate."""
    words = dictionary(docs, text_col)
    found = materialize(candidates(docs, words, id_col, text_col, path_col), f"{name}_candidates")
    return score(found, fit(found, findings)).drop("features", "harmless").withColumn("secret", F.col("score") >= 0.5)
