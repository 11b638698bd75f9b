"""Token ids in length-delimited binary records, with a separate offset index for shuffled reads.

A data file is a run of records.  A record is, little-endian:

    uint64 length of the payload | uint32 masked CRC of these 8 bytes | payload | uint32 masked CRC of the payload

with ``masked = ((crc >> 15 | crc << 17) + 0xA282EAD8) mod 2**32`` of the CRC-32 that zlib computes.  The payload is an
int64 id, a byte that is 1 for a null id, a byte with the width of a token id (2 where every id of the vocabulary fits,
else 4), and the token ids.  The end id follows every document.

Documents are ranged by id (equal ids by text), so file after file holds them in ascending order.  Every task writes files
under a name of its own and hands out index rows only for files that it has closed; a task that is lost or runs twice
leaves files that no index row names.  The index is a Parquet table (file, offset, size, id, n_tokens, shard, place), so any
set of records can be read in any order.

Defined results: a null or empty text is the end id alone; rows that repeat an id are records of their own, and a null id
comes first.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnwise.llm.common import arrow_rows, hold, materialize
from turnwise.session import scratch_root

TOKENIZER, END_ID = public_tokenizers.path("byte_bpe_50k.json"), 2
UNITS = 1_500_000
FILE_BYTES = 256 * 2**20  # a task begins another file beyond this
_HEAD, _FRAME = struct.Struct("<qBB"), struct.Struct("<QI")
INDEX = "doc_id long, file string, offset long, size long, n_tokens long, shard int, place long"


class RecordError(ValueError):
    """A record whose length or payload does not match its checksum."""


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload))


def unframe(data: bytes) -> bytes:
    """The payload of one framed record; RecordError if any part of it is damaged."""
    if len(data) < 16:
        raise RecordError("record cut short")
    length, crc = _FRAME.unpack_from(data)
    if masked_crc(data[:8]) != crc or len(data) != length + 16:
        raise RecordError("damaged length")
    payload = data[12:-4]
    if masked_crc(payload) != struct.unpack("<I", data[-4:])[0]:
        raise RecordError("damaged payload")
    return payload


def payload(doc_id: int | None, width: int, packed: bytes) -> bytes:
    return _HEAD.pack(doc_id or 0, doc_id is None, width) + packed


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    """The id and the token ids of a payload."""
    doc_id, absent, width = _HEAD.unpack_from(data)
    return None if absent else doc_id, np.frombuffer(data, dtype=f"<u{width}", offset=_HEAD.size)


class _Table(dict):
    """Known units of text; a look-up of an unknown one notes it and gives None."""

    def __init__(self):
        super().__init__()
        self.missed: list[str] = []

    def __missing__(self, unit: str) -> None:
        self.missed.append(unit)


class Encoder:
    """Texts to packed token ids by a tokenizer file of the ``tokenizers`` library, as the library gives them, special strings included.

    A byte-level tokenizer encodes the pieces into which its pattern splits a text one by one.  Where every space stands
    alone, each begins a piece, so the text may be cut before every space, and units seen before are taken from a
    table, which is emptied when it has grown large.  New units are encoded as one running text.  Other texts, those that hold a string the
    tokenizer knows as a token of its own, and those of other tokenizers are encoded whole.
    """

    def __init__(self, path: str, most: int = UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.width = "<u2" if self.tokenizer.get_vocab_size() < 2**16 else "<u4"
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        before = config.get("pre_tokenizer") or {}
        plain = not config.get("normalizer") and not config.get("truncation") and not config.get("padding")
        self.by_units = plain and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.known, self.most = _Table(), most
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.after_space = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.after_space[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.marks = dict(zip(",.", self._packed([",", "."]), strict=True))

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.width).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Put units, each meant to follow a space, into the table.

        The pattern parts a word from the comma or full stop behind it, so such units are put together from their word.
        """
        known, marks = self.known, self.marks
        ended = [u for u in new if u[-1] in marks and u[:-1].isalpha()]
        if ended:
            apart = set(ended)
            new = [u for u in new if u not in apart]
            new += [w for w in dict.fromkeys([u[:-1] for u in ended]) if w not in known]
        for start in range(0, len(new), 10_000):
            self._run(new[start : start + 10_000])
        known.update([(u, known[u[:-1]] + marks[u[-1]]) for u in ended])

    def _run(self, units: list[str]) -> None:
        """Encode units as one running text, a space before each."""
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(units)], add_special_tokens=False)[0].ids, dtype=self.width)
        starts = np.flatnonzero(self.after_space[ids])
        if len(starts) != len(units):  # a tokenizer that joins units after all
            self.known.update(zip(units, self._packed([" " + u for u in units]), strict=True))
            return
        edges = (starts * ids.itemsize).tolist()
        packed = ids.tobytes()
        self.known.update(zip(units, map(packed.__getitem__, map(slice, edges, [*edges[1:], len(packed)])), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) > self.most:
            known.clear()
        units = [t.split(" ") if self.by_units and not any(a in t for a in self.added) else [""] for t in texts]
        firsts = self._packed([u[0] for u in units])
        found = [list(map(known.__getitem__, u[1:])) for u in units]
        missed = known.missed
        known.missed = []
        # A unit that is empty or has white space at an end stands next to crowded spaces: its text is encoded whole.
        new = [u for u in dict.fromkeys(missed) if u and not (u[0].isspace() or u[-1].isspace())]
        self._learn(new)
        learnt = map(known.get, missed)  # in the order in which they are wanted below
        whole = []
        for i, u in enumerate(units):
            row, gaps = found[i], found[i].count(None)
            at = -1
            for _ in range(gaps):
                at = row.index(None, at + 1)
                row[at] = next(learnt)
            if gaps and None in row or not u[0] or u[0][-1].isspace():
                whole.append(i)
        packed = dict(zip(whole, self._packed([texts[i] for i in whole]), strict=True))
        return [packed[i] if i in packed else first + b"".join(rest) for i, (first, rest) in enumerate(zip(firsts, found, strict=True))]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, most: int = UNITS) -> Encoder:
    hold("token_records", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].most = most
    return _ENCODERS[path]


def _writer(folder: str, path: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pa.fs.FileSystem.from_uri(folder)
        shard, place, out, file, offset = TaskContext.get().partitionId(), 0, None, "", 0
        code = encoder(path, most)
        end = np.array([end_id], dtype=code.width).tobytes()
        width = np.dtype(code.width).itemsize
        rows: list[tuple] = []
        try:
            for batch in arrow_rows(batches, 256):
                ids = batch.column("id").to_pylist()
                texts = [(t or b"").decode("utf-8", "replace") for t in batch.column("body").to_pylist()]
                for doc_id, packed in zip(ids, code.encode(texts), strict=True):
                    if out is None:
                        file, offset = f"{shard:06d}-{uuid.uuid4().hex}.tok", 0
                        out = store.open_output_stream(f"{base}/{file}")
                    record = frame(payload(doc_id, width, packed + end))
                    out.write(record)
                    rows.append((doc_id, file, offset, len(record), len(packed) // width + 1, shard, place))
                    offset, place = offset + len(record), place + 1
                    if offset > FILE_BYTES:
                        out.close()
                        out = None
                        yield _index(rows)
                        rows = []
            if out is not None:
                out.close()
                out = None
            if rows:
                yield _index(rows)
        finally:
            if out is not None:
                out.close()

    return run


def _index(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = ["doc_id", "file", "offset", "size", "n_tokens", "shard", "place"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def write_records(
    docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER, end_id: int = END_ID, most: int = UNITS
) -> tuple[DataFrame, str]:
    """Write all documents as records in a new folder of the shared folder; give the index and the folder.

    ``most`` bounds the units of text (about 200 bytes each) that a Python worker remembers.
    """
    root = scratch_root(docs.sparkSession)
    folder = f"{root if '://' in root or root.startswith('/') else root.replace('file:', 'file://', 1)}/turnwise/{name}-{uuid.uuid4().hex}"
    store, base = pa.fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("body"))
    order = ["id", F.xxhash64("body")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.mapInArrow(_writer(folder, path, end_id, most), INDEX), f"{name}_index"), folder


def _reader(folder: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pa.fs.FileSystem.from_uri(folder)
        opened, handle = None, None
        try:
            for batch in arrow_rows(batches, 512 if digest else 64):
                ids, found = [], []
                for file, offset, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "size")), strict=True):
                    if file != opened:
                        if handle is not None:
                            handle.close()
                        opened, handle = file, store.open_input_file(f"{base}/{file}")
                    doc_id, tokens = parse(unframe(handle.read_at(size, offset)))
                    ids.append(doc_id)
                    found.append((len(tokens), zlib.crc32(tokens.astype("<u4").tobytes())) if digest else tokens.astype(np.int32).tolist())
                own = [pa.array(ids, pa.int64()), batch.column("shard"), batch.column("place")]
                if digest:
                    yield pa.RecordBatch.from_arrays(
                        [*own, pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64())], names=["doc_id", "shard", "place", "n_tokens", "ids_crc32"]
                    )
                else:
                    yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "shard", "place", "tokens"])
        finally:
            if handle is not None:
                handle.close()

    return run


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, shard, place, tokens) of the records that the index rows name, in the rows' order; checksums are verified."""
    return index.mapInArrow(_reader(folder, False), "doc_id long, shard int, place long, tokens array<int>")


def read_shuffled(index: DataFrame, folder: str, seed: int) -> DataFrame:
    """All records in an order drawn from the seed."""
    drawn = F.xxhash64("file", "offset", F.lit(seed))
    return read_records(index.repartitionByRange(drawn).sortWithinPartitions(drawn), folder)


def read_digests(index: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read back from the files.

    ``start`` counts the ids of all earlier records: those of earlier shards (one row each) and of the shard's earlier places.
    """
    found = materialize(index.mapInArrow(_reader(folder, True), "doc_id long, shard int, place long, n_tokens long, ids_crc32 long"), "token_digests")
    shards = found.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    shards = shards.select("shard", (F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).alias("earlier"))
    within = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("place")) - F.col("n_tokens")
    return found.withColumn("within", within).join(shards, "shard").select("doc_id", (F.col("earlier") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
