from __future__ import annotations

import random

from tokenizers import Tokenizer, models, normalizers

from tests.llm.tables import ODD_TEXTS
from turnwise.llm import token_counts as C


def library(vocabulary):
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    tokenizer.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)


TEXTS = [t for t in ODD_TEXTS if len(t or "") < 10_000] + ["x" * 3000, "a<unk>b 漢字漢 字", "  two  spaces ", "\n\n", "🎉🎉 🎉", "▁", "<unk><unk>", "don't stop"]


def test_file_vocabulary_equals_the_library():
    vocabulary = C.load_vocabulary(C.VOCABULARY)
    count, exact = C.Counter(vocabulary, most=5).count, library(vocabulary)
    assert [count(t or "") for t in TEXTS] == [exact(t) for t in TEXTS]


def test_ties_equal_the_library():
    """Small vocabularies of whole scores, where many segmentations are equally good."""
    rng = random.Random(8)
    for _ in range(150):
        pieces = {"".join(rng.choice("ab▁") for _ in range(rng.choice([1, 1, 2, 2, 3, 4]))) for _ in range(rng.choice([2, 5, 9]))}
        vocabulary = [("<unk>", 0.0), *((p, -float(rng.randrange(4))) for p in sorted(pieces))]
        count, exact = C.Counter(vocabulary).count, library(vocabulary)
        for _ in range(20):
            text = "".join(rng.choice("aab c") for _ in range(rng.randrange(12)))
            assert count(text) == exact(text), (vocabulary, text)


def test_rows(documents):
    exact = library(C.load_vocabulary(C.VOCABULARY))
    rows = [*enumerate(TEXTS), (None, "a b"), (3, "a b"), (3, "a b")]
    got = sorted(((r.id or -1), r.n_tokens) for r in C.token_counts(documents(rows)).collect())
    assert got == sorted(((i or -1), exact(t)) for i, t in rows)
    assert C.token_counts(documents([])).count() == 0


def test_a_full_table_keeps_the_words_that_come_again():
    counter, asked = C.Counter([("<unk>", 0.0), ("▁", -1.0), ("a", -2.0)], most=8), []
    pieces = counter.pieces
    counter.pieces = lambda word: asked.append(word) or pieces(word)
    for i in range(60):
        counter.count(f"often x{i}")
    assert asked.count("▁often") == 1


def test_characters_of_no_piece_equal_the_library():
    vocabulary = C.load_vocabulary(C.VOCABULARY)
    count, exact = C.Counter(vocabulary).count, library(vocabulary)
    texts = ["one.\nTwo\n\n\rthree", "\n", "\n\nx", "x\n\r\n", " \n", "  a\n \n", "<unk>\n<unk>", "a\n<unk>\nb", "trailing  ", "▁a ▁\n"]
    assert [count(t) for t in texts] == [exact(t) for t in texts]


def test_fractional_scores_and_odd_characters_equal_the_library():
    rng = random.Random(9)
    for _ in range(100):
        pieces = {"".join(rng.choice("ab▁") for _ in range(rng.choice([1, 2, 3]))) for _ in range(6)} | {"▁", "cd"}
        vocabulary = [("<unk>", 0.0), *((p, -rng.choice([0.5, 1.25, 3.0])) for p in sorted(pieces))]
        count, exact = C.Counter(vocabulary).count, library(vocabulary)
        for _ in range(20):
            text = "".join(rng.choice("aab cd\n") for _ in range(rng.randrange(12)))
            assert count(text) == exact(text), (vocabulary, text)
