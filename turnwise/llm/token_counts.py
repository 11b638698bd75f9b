"""Token counts of a unigram tokenizer without making its tokens.

The vocabulary's pieces and scores are those of a tokenizer file.  White space becomes ``▁`` and one is put before the text.
No piece has a ``▁`` behind another character and ``▁`` is a piece, so the best segmentation of a text is that of its words,
each begun by its run of ``▁``; a word's count is found once and kept in a bounded table.  (With another vocabulary a text is
taken whole.)

For a word, an Aho-Corasick automaton enumerates every piece that ends at every place, and dynamic programming carries the best
score and the number of pieces to each place.  Ties follow the tokenizer: beginnings are tried from left to right, at each
one the pieces from short to long, and a later candidate wins only with a strictly better score.  Where no piece of
one character begins, the unknown piece stands in, at the lowest score less ten; neighbouring unknown pieces are one.
Characters that are in no piece cut a word where they stand, if scores are whole numbers.

Defined results: null and empty texts have no pieces; repeated rows are counted each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import arrow_rows, hold

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
UNKNOWN_PENALTY = 10.0
MARK = "▁"
_NONE = float("-inf")
_WORD = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """The unknown piece, then (piece, score) of every ordinary piece of the file."""
    file = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(file.get_piece_size())
    unknown = [i for i in ids if file.is_unknown(i)]
    plain = [i for i in ids if not (file.is_control(i) or file.is_unknown(i) or file.is_byte(i) or file.is_unused(i))]
    return [(file.id_to_piece(i), file.get_score(i)) for i in unknown + plain]


class Remembered:
    """What short strings gave, at most ``most`` of them: when the younger half is full, the older one goes and what is met again stays."""

    def __init__(self, most: int):
        self.half, self.young, self.old = max(1, most // 2), {}, {}

    def get(self, key: str):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value):
        if len(key) < 64:
            if len(self.young) >= self.half:
                self.young, self.old = {}, self.young
            self.young[key] = value
        return value


class Counter:
    """Counts pieces of texts; ``vocabulary`` begins with the unknown piece."""

    def __init__(self, vocabulary: list[tuple[str, float]], most: int = 200_000):
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == 0))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.by_words = all(MARK not in piece.lstrip(MARK) for piece, _ in vocabulary) and any(piece == MARK for piece, _ in vocabulary)
        self.unknown_piece = vocabulary[0][0]
        self.singles = {piece for piece, _ in vocabulary[1:] if len(piece) == 1} - {self.unknown_piece}
        self.characters = {c for piece, _ in vocabulary for c in piece}
        # Sums of whole numbers do not depend on where they begin; other scores could round a tie away.
        self.whole = all(float(score).is_integer() for _, score in vocabulary)
        self.words = Remembered(most)

    def pieces(self, word: str) -> int:
        """Pieces of the best segmentation of an unbroken text.

        At each end the automaton gives the longest piece first and one of one character last, so candidates come from left to right.
        """
        if not word:
            return 0
        odd = set(word) - self.singles
        if self.unknown_piece in word or not (self.whole and odd.isdisjoint(self.characters)):
            return self._odd_pieces(word)
        if odd:  # characters of no piece: each run of them is one unknown piece, what lies between is segmented alone
            stop = odd.pop()
            for other in odd:
                word = word.replace(other, stop)
            parts = word.split(stop)
            return len(parts) - 1 - parts[1:-1].count("") + sum(map(self.pieces, parts))
        best, count, top, start = [0.0], [0], _NONE, 0
        for end, (length, score, _) in self.automaton.iter(word):
            begin = end + 1 - length
            value = best[begin] + score
            if value > top:
                top, start = value, begin
            if length == 1:
                best.append(top)
                count.append(count[start] + 1)
                top = _NONE
        return count[-1]

    def _odd_pieces(self, word: str) -> int:
        """The same where unknown pieces may occur anywhere."""
        begins: list[list[tuple[int, float, bool]]] = [[] for _ in word]
        for end, found in self.automaton.iter(word):
            begins[end + 1 - found[0]].append(found)
        best: list[float | None] = [0.0] + [None] * len(word)
        count, unknown = [0] * (len(word) + 1), [False] * (len(word) + 1)
        for start, found in enumerate(begins):
            if not any(length == 1 for length, _, _ in found):
                found.append((1, self.unknown, True))
            for length, score, odd in sorted(found):
                at, value = start + length, best[start] + score
                if best[at] is None or value > best[at]:
                    best[at], unknown[at] = value, odd
                    count[at] = count[start] + (not (odd and unknown[start]))
        return count[-1]

    def count(self, text: str) -> int:
        """Pieces of a text, a ``▁`` put before it and for every space."""
        if not text:
            return 0
        if not self.by_words:
            return self.pieces(MARK + text.replace(" ", MARK))
        # Words without the first ``▁`` they begin with.
        if MARK in text or "  " in text or text[0] == " ":
            found = [word[1:] for word in _WORD.findall(MARK + text.replace(" ", MARK))]
        else:
            found = text.split(" ")
        total, words = 0, self.words
        for word in found:
            n = words.young.get(word)
            if n is None and (n := words.get(word)) is None:
                n = words.put(word, self.pieces(MARK + word))
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(load_vocabulary(path))


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("token_counts", counter.cache_clear)
        counts = counter(path)
        for batch in arrow_rows(batches):
            found = [counts.count((b or b"").decode("utf-8", "replace")) for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.int64())], names=["id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens) of every row, in one pass without a shuffle."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("body"))
    return rows.mapInArrow(_counts(path), f"id {kind}, n_tokens long")
