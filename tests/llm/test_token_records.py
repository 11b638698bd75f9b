from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow.fs
import pytest
from tokenizers import Tokenizer

from tests.llm.tables import ODD_TEXTS
from turnwise.llm import token_records as R


def ids_of(text):
    tokenizer = Tokenizer.from_file(R.TOKENIZER)
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, R.END_ID]


def test_encoder_equals_the_library():
    texts = [t or "" for t in ODD_TEXTS] + ["it's  we'll\n\n\tx  ", "<|endoftext|> a", "x <|endoftext|> y", "a<|endoftext|>b c", "<|endoftext|>", "<| endoftext |>", "123 45,6 'tis ''s 's", "  ", "a b　c ́x"]
    got = [np.frombuffer(b, "<u2").tolist() for b in R.Encoder(R.TOKENIZER, most=3).encode(texts)]
    assert got == [ids_of(t)[:-1] for t in texts]


def test_files_read_byte_by_byte(documents):
    rows = [*((i * 3 % 11, t) for i, t in enumerate(ODD_TEXTS)), (None, "no id"), (4, "again"), (4, "again")]
    index, folder = R.write_records(documents(rows), "test")
    store, base = pyarrow.fs.FileSystem.from_uri(folder)
    named = sorted(index.collect(), key=lambda r: (r.shard, r.place))
    got = []
    for file in dict.fromkeys(r.file for r in named):
        data, at = store.open_input_file(f"{base}/{file}").read(), 0
        while at < len(data):
            (length,) = struct.unpack_from("<Q", data, at)
            crc = zlib.crc32(data[at : at + 8])
            assert struct.unpack_from("<I", data, at + 8)[0] == (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF
            doc_id, absent, width = struct.unpack_from("<qBB", data, at + 12)
            got.append((None if absent else doc_id, np.frombuffer(data[at + 22 : at + 12 + length], f"<u{width}").tolist()))
            at += length + 16
        assert at == len(data)
    assert [i for i, _ in got] == [None, *sorted(i for i, _ in rows if i is not None)]
    assert sorted(map(repr, got)) == sorted(repr((i, ids_of(t))) for i, t in rows)


def test_digests(documents):
    rows = [(5, "b c"), (1, None), (9, "a longer text"), (2, "")]
    index, folder = R.write_records(documents(rows), "test")
    got = sorted(map(tuple, R.read_digests(index, folder).collect()))
    start, expected = 0, []
    for i, t in sorted(rows):
        ids = ids_of(t)
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == expected


def test_shuffled_reads(documents):
    rows = [(i, f"text number {i}") for i in range(50)]
    index, folder = R.write_records(documents(rows), "test")
    one, same, other = ([tuple(r)[0] for r in R.read_shuffled(index, folder, s).collect()] for s in (1, 1, 2))
    assert one == same and one != other and sorted(one) == sorted(other) == list(range(50))
    tokens = {r.doc_id: r.tokens for r in R.read_records(index.where("doc_id = 7"), folder).collect()}
    assert tokens == {7: ids_of("text number 7")}


def test_large_files_are_split(documents, monkeypatch):
    monkeypatch.setattr(R, "FILE_BYTES", 100)
    index, folder = R.write_records(documents([(i, "some words here " * 3) for i in range(20)], parts=1), "test")
    assert index.select("file").distinct().count() > 5
    assert R.read_digests(index, folder).count() == 20


def test_damage_is_found():
    good = R.frame(b"payload")
    assert R.unframe(good) == b"payload"
    for at in range(len(good)):
        with pytest.raises(R.RecordError):
            R.unframe(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])
    with pytest.raises(R.RecordError):
        R.unframe(good[:-1])


def test_empty_table(documents):
    index, folder = R.write_records(documents([]), "test")
    assert R.read_digests(index, folder).count() == 0
