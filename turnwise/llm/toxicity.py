"""Toxicity by a learnt lexicon, misspellings and context.

1. *Lexicon.*  Over labelled documents, the documents of either label are counted for every whole word and for every word
   beginning of ``STEMS`` letters.  An entry is a word, or a beginning that many different words share, whose documents are
   toxic far more often than chance allows (a binomial bound over all counted entries); what stands between quotation marks is
   not counted, so that clean texts may quote.  Copies of one text are no further
   evidence: toxic documents are told apart by the least hash of their words, near copies mostly having the same.
2. *Matching.*  The lexicon is a trie.  A word's Levenshtein automaton (insertions, deletions, substitutions and swaps of
   neighbours; one edit from 5 letters on, two from 9) runs over the trie, so misspelt terms are found without a list of
   variants.  A variant that clean labelled documents use is an ordinary word and dropped.
3. *Context.*  Each find looks at the ``WINDOW`` words on either side: quotation marks around it and words of reporting speak for a
   quotation, words addressing a reader for abuse.
4. *Score.*  A logistic model over counts of exact and misspelt finds, quoted and not, addressed and not.

The lexicon and the model are fitted on at most about ``TRAIN_ROWS`` labelled documents, drawn by a hash of the id; this bounds
both, so they can be sent to every executor.  Scoring is one pass over the texts without a shuffle.

Defined results: null and empty texts have no finds and get the model's score for none; repeated rows get equal scores; ids
with several labels are toxic if one says so; labels that are null are ignored; with no label of one kind every score is
the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import arrow_rows, hold, materialize, md5_unit

TRAIN_ROWS = 200_000  # labelled documents that the lexicon and the model are fitted on, about
STEMS = (4, 5, 6)
KINDS = 63
CHANCE = 0.02  # entries that chance alone may bring into the lexicon
PURE = 0.8  # least share of toxic documents among those with an entry
WINDOW = 6
HELD_OUT = 5  # ids whose CRC-32 is divisible by this are never learnt from

#: Words that report another's speech, and words that address a reader. Fixed values.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes according word words term sagte schrieb nannte laut dit écrit appelé selon dijo escribió llamó según".split())
ADDRESSING = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre usted tú ti tus ustedes".split())
QUOTES = frozenset("\"“”„«»‹›‘’`")

_WORD = re.compile(r"[^\W\d_]+")
_QUOTATION = re.compile(r"\"[^\"\n]{0,200}\"|“[^”\n]{0,200}”|„[^“\n]{0,200}“|«[^»\n]{0,200}»")
_QUOTED = re.compile(r"[\"“”„«»‹›‘’`]")


# ---------------------------------------------------------------- lexicon

def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts to (entry, toxic, clean, kinds), summed within the task as far as memory allows.

    ``kinds`` has a bit for the least word hash of every toxic text, from which the number of different ones is estimated.
    """
    hold("toxicity_counts", _FINDERS.clear)
    found: tuple[Counter, Counter] = (Counter(), Counter())
    kinds: dict[str, int] = {}

    def rows() -> pa.RecordBatch:
        names = list(found[0].keys() | found[1].keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in reversed(found)), pa.array([kinds.get(n, 0) for n in names], pa.int64())],
            names=["entry", "toxic", "clean", "kinds"],
        )
        for table in (*found, kinds):
            table.clear()
        return out

    for batch in arrow_rows(batches):
        for label, body in zip(batch.column("label").to_pylist(), batch.column("body").to_pylist(), strict=True):
            words = set(_WORD.findall(_QUOTATION.sub(" ", (body or b"").decode("utf-8", "replace").lower())))
            entries = {w[:n] for n in STEMS for w in words if len(w) > n}
            entries.update(w + "$" for w in words)
            found[label].update(entries)
            if label and words:
                bit = 1 << min(xxhash.xxh3_64_intdigest(w) for w in words) % KINDS
                for e in entries:
                    kinds[e] = kinds.get(e, 0) | bit
        if len(found[0]) + len(found[1]) > 200_000:
            yield rows()
    yield rows()


def _learn(counts: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Entries and their log odds.  What is collected here is bounded by the labelled sample."""
    counted = counts.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_count(F.bit_or("kinds")).alias("bits"))
    counted = materialize(counted.where("toxic > 2"), "toxicity_entries")
    base = toxic / (toxic + clean)
    kinds = -KINDS * F.log(1 - F.least(F.col("bits"), F.lit(KINDS - 1)) / KINDS)
    texts = F.when(F.col("bits") >= KINDS - 1, F.col("toxic")).otherwise(F.least(F.col("toxic"), kinds))
    share = texts / (texts + F.col("clean"))
    apart = texts * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    likely = counted.where(share >= PURE).where(apart > math.log(max(2, counted.count()) / CHANCE))
    rows = {r.entry: (r.toxic, r.clean) for r in likely.collect()}
    whole = {e: v for e, v in rows.items() if e.endswith("$")}
    best: Counter = Counter()
    for e, (n, _) in whole.items():
        for k in STEMS:
            if len(e) - 1 > k:
                best[e[:k]] = max(best[e[:k]], n)
    stems: list[str] = []
    for e in sorted((e for e in rows if not e.endswith("$")), key=len):
        # A beginning that one word explains is that word; one that a shorter beginning covers is not needed.
        if rows[e][0] > 1.3 * best[e] and not any(e.startswith(s) for s in stems):
            stems.append(e)
    # The longest beginning that has about the same documents says as much, and of fewer words.
    longer = sorted((e for e in rows if not e.endswith("$")), key=len, reverse=True)
    stems = [next(e for e in longer if e.startswith(s) and rows[e][0] >= 0.95 * rows[s][0]) for s in stems]
    # Whole words stay beside the beginnings that cover them, since only whole words are found with edits.
    kept = [*whole, *stems]
    return {e: math.log((rows[e][0] + 0.5) / (rows[e][1] + 0.5) * (clean + 1) / (toxic + 1)) for e in kept}


# ---------------------------------------------------------------- matching

def edits_allowed(entry: str) -> int:
    letters = len(entry.rstrip("$"))
    if not entry.endswith("$"):
        return 0
    return 0 if letters < 5 else 1 if letters < 9 else 2


class _State(dict):
    """A state of the automaton: characters to next states, made when first read; None where no entry can follow.

    ``items`` are places in the trie with the edits spent so far, some waiting for the second letter of a swap.
    """

    __slots__ = ("begun", "items", "lexicon", "whole")

    def __init__(self, lexicon: Lexicon, items: frozenset):
        super().__init__()
        self.lexicon, self.items = lexicon, items
        nodes = [(edits, lexicon.nodes[node]) for node, edits, wait in items if not wait]
        #: The best beginning found on reaching this state, and the best whole word if the text ends here.
        self.begun = min(((e, n["entry"]) for e, n in nodes if "entry" in n and e <= edits_allowed(n["entry"])), default=None)
        ends = [(e, lexicon.nodes[n["$"]]["entry"]) for e, n in nodes if "$" in n]
        self.whole = min((x for x in ends if x[0] <= edits_allowed(x[1])), default=None)

    def __missing__(self, c: str) -> _State | None:
        found = self[c] = self.lexicon.after(self.items, c)
        return found


class Lexicon:
    """A trie of entries, intersected with the Levenshtein automaton of whatever word is read.

    The intersection is made deterministic as it is used: a state is the set of trie places that the letters read so
    far can have led to, so a word costs one look-up a letter and ends at once where nothing can follow.
    """

    def __init__(self, entries: dict[str, float]):
        self.nodes: list[dict] = [{}]
        self.most: list[int] = [0]  # edits that some entry below a node allows
        for entry in entries:
            at, allowed = 0, edits_allowed(entry)
            self.most[0] = max(self.most[0], allowed)
            for c in entry:
                if c not in self.nodes[at]:
                    self.nodes[at][c] = len(self.nodes)
                    self.nodes.append({})
                    self.most.append(0)
                at = self.nodes[at][c]
                self.most[at] = max(self.most[at], allowed)
            self.nodes[at]["entry"] = entry
        self._restart()

    def _restart(self) -> None:
        self.states: dict[frozenset, _State] = {}
        self.start = self._state({(0, 0, "")})

    def _letters(self, node: int):
        return ((c, child) for c, child in self.nodes[node].items() if len(c) == 1 and c != "$")

    def _state(self, items: set) -> _State:
        todo = [x for x in items if not x[2]]
        while todo:  # letters left out
            node, edits, _ = todo.pop()
            for _, child in self._letters(node):
                new = (child, edits + 1, "")
                if edits < self.most[child] and new not in items:
                    items.add(new)
                    todo.append(new)
        least: dict[tuple[int, str], int] = {}
        for node, edits, wait in items:
            least[node, wait] = min(edits, least.get((node, wait), edits))
        key = frozenset((node, edits, wait) for (node, wait), edits in least.items())
        if key not in self.states:
            self.states[key] = _State(self, key)
        return self.states[key]

    def after(self, items: frozenset, c: str) -> _State | None:
        found: set = set()
        for node, edits, wait in items:
            if wait:
                if wait == c:
                    found.add((node, edits, ""))
                continue
            same = self.nodes[node].get(c)
            if same is not None and c != "$":
                found.add((same, edits, ""))
            if edits < self.most[node]:
                found.add((node, edits + 1, ""))  # a letter too many
                for x, child in self._letters(node):
                    if edits < self.most[child]:
                        found.add((child, edits + 1, ""))  # another letter
                        swapped = self.nodes[child].get(c)
                        if swapped is not None and c != "$" and x != c and edits < self.most[swapped]:
                            found.add((swapped, edits + 1, x))
        return self._state(found) if found else None

    def find(self, word: str) -> tuple[str, int] | None:
        """The entry nearest to the word and its edits; the first in alphabetical order of equally near ones."""
        if len(self.states) > 50_000:
            self._restart()
        state, best = self.start, None
        for c in word:
            state = state[c]
            if state is None:
                break
            if state.begun is not None and (best is None or state.begun < best):
                best = state.begun
        else:
            if state.whole is not None and (best is None or state.whole < best):
                best = state.whole
        return None if best is None else (best[1], best[0])


@dataclass
class Model:
    """What is sent to the executors."""

    entries: dict[str, float] = field(default_factory=dict)
    ordinary: frozenset[str] = frozenset()
    weights: tuple[float, ...] = ()
    score_none: float = 0.0


FEATURES = ("exact", "misspelt", "quoted_exact", "quoted_misspelt", "addressed", "strength")


class Finder:
    """Finds of a text by a model; words seen before are looked up in bounded tables."""

    def __init__(self, model: Model):
        self.model, self.lexicon = model, Lexicon(model.entries)
        self.hits: dict[str, tuple[str, int]] = {}
        self.clean: set[str] = set()

    def _new(self, words: set[str]) -> None:
        if len(self.clean) > 300_000:
            self.clean.clear()
        for w in words:
            found = None if w in self.model.ordinary else self.lexicon.find(w)
            if found:
                self.hits[w] = found
            else:
                self.clean.add(w)

    def features(self, text: str) -> tuple[list[float], set[str]] | None:
        """Feature values and the misspelt words, or None without a find."""
        low = text.lower()
        words = set(_WORD.findall(low))
        new = words - self.clean
        self._new(new - self.hits.keys())
        present = new & self.hits.keys()
        if not present:
            return None
        spans = [m.span() for m in _WORD.finditer(low)]
        seen: set[tuple[str, bool, bool]] = set()
        addressed, strength, variants = 0, 0.0, set()
        for i, (start, end) in enumerate(spans):
            word = low[start:end]
            if word not in present:
                continue
            entry, edits = self.hits[word]
            near = spans[max(0, i - WINDOW) : i + WINDOW + 1]
            around = {low[a:b] for a, b in near}
            left, right = low[near[0][0] : start], low[end : near[-1][1]]
            quoted = bool(_QUOTED.search(left) and _QUOTED.search(right)) or bool(around & REPORTING)
            seen.add((entry, edits > 0, quoted))
            addressed |= bool(around & ADDRESSING)
            if edits:
                variants.add(word)
            else:
                strength = max(strength, self.model.entries[entry])
        count = Counter((wrong, quoted) for _, wrong, quoted in seen)
        cut = lambda n: min(n, 3) / 3
        return [cut(count[False, False]), cut(count[True, False]), cut(count[False, True]), cut(count[True, True]), float(addressed), min(strength, 10.0) / 10], variants


_FINDERS: dict[str, Finder] = {}


def _finder(shared) -> Finder:
    hold("toxicity", _FINDERS.clear)
    if shared.id not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[shared.id] = Finder(shared.value)
    return _FINDERS[shared.id]


class _Shared:
    """A broadcast with a name of its own, for the table of finders in each worker."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self) -> Model:
        return self.broadcast.value


def _train_rows(shared: _Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared)
        for batch in arrow_rows(batches):
            found = [finder.features((b or b"").decode("utf-8", "replace")) for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([f[0] if f else [] for f in found], pa.list_(pa.float64())), pa.array([sorted(f[1]) if f else [] for f in found], pa.list_(pa.string()))],
                names=["label", "features", "variants"],
            )

    return run


def _scores(shared: _Shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(shared)
        model = finder.model
        for batch in arrow_rows(batches):
            scores = []
            for body in batch.column("body").to_pylist():
                found = finder.features((body or b"").decode("utf-8", "replace")) if model.entries else None
                scores.append(_logistic(model.weights, found[0]) if found else model.score_none)
            own = [i for i, f in enumerate(batch.schema) if f.name != "body"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in own), pa.array(scores, pa.float64())], names=[*(batch.schema.names[i] for i in own), "score"])

    return run


def _logistic(weights: tuple[float, ...], values: list[float]) -> float:
    z = weights[0] + sum(w * v for w, v in zip(weights[1:], values, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, ...]:
    """Weights (intercept first) of a ridge logistic model over distinct feature rows with counts, by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.5)
    ridge[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - n * p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def held_out(doc_id: Column) -> Column:
    """Whether the id belongs to the part that is never learnt from; a null id does."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the labelled documents outside the held-out part."""
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label in (0, 1) and id is not null")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    rate = min(1.0, TRAIN_ROWS / max(1, known.count()))
    sample = F.broadcast(known.where(md5_unit(F.col("id"), F.lit("train")) < rate))  # about TRAIN_ROWS narrow rows at most
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("body")).join(sample, "id").select("label", "body")
    tally = {r.label: r.n for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = tally.get(1, 0), tally.get(0, 0)
    if not toxic or not clean:
        return Model(score_none=toxic / max(1, toxic + clean))
    entries = _learn(texts.mapInArrow(_counts, "entry string, toxic long, clean long, kinds long"), toxic, clean)
    model = Model(entries, score_none=toxic / (toxic + clean))
    if not entries:
        return model
    shared = _Shared(spark.sparkContext.broadcast(model))
    rows = texts.mapInArrow(_train_rows(shared), "label int, features array<double>, variants array<string>").groupBy("label", "features", "variants").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.where(F.size("features") > 0).collect()  # distinct rows of the bounded sample
    uses: dict[str, list[int]] = {}
    for r in rows:
        for v in r.variants:
            uses.setdefault(v, [0, 0])[r.label] += r.n
    model.ordinary = frozenset(v for v, (c, t) in uses.items() if c > 0 and t < 4 * c)
    # Documents whose only finds are ordinary words count as having none.
    groups: dict[tuple, list[int]] = {}
    hits = [0, 0]
    for r in rows:
        values = tuple(r.features)
        if r.variants and model.ordinary.issuperset(r.variants):
            values = (values[0], 0.0, values[2], 0.0, values[4], values[5])
        if any(values[:4]):
            groups.setdefault(values, [0, 0])[r.label] += r.n
            hits[r.label] += r.n
    model.score_none = (toxic - hits[1] + 0.5) / (toxic + clean - sum(hits) + 1.0)
    x, found = np.array(list(groups)), np.array(list(groups.values()))
    # Texts without a find keep the zero point of the model in place.
    x = np.vstack([x, np.zeros((1, len(FEATURES)))])
    found = np.vstack([found, [[clean - hits[0], toxic - hits[1]]]])
    model.weights = _fit(x, found[:, 1].astype(float), found.sum(axis=1).astype(float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash of the text, score) of every row."""
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(model))
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(f"`{text_col}`").cast("binary").alias("body"))
    return rows.mapInArrow(_scores(shared), f"id {kind}, hash long, score double")


def without_toxic(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below one half."""
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(model))

    @F.arrow_udf("double")
    def scored(bodies: pa.Array) -> pa.Array:
        finder = _finder(shared)
        found = (finder.features((b or b"").decode("utf-8", "replace")) if model_has else None for b in bodies.to_pylist())
        return pa.array([_logistic(finder.model.weights, f[0]) if f else finder.model.score_none for f in found], pa.float64())

    model_has = bool(model.entries)
    return docs.where(scored(F.col(f"`{text_col}`").cast("binary")) < 0.5)
