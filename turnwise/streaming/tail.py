"""Follow append-only line files: a streaming source that reads only the bytes that were added.

An offset names a *manifest* of positions, one entry per file: up to which byte it was read, and fingerprints of its first bytes and of those
before that position.  A file is read on from its position while it is at least that long and both fingerprints hold.  One that shrank,
or whose content is another now, starts again from the top under the next ``generation``, so readers can tell what is void.
Half-written last lines wait: a position is always the start of a line.

Rows are ``(path, generation, line_no, upto, value)``.  ``line_no`` is the byte at which the line starts, which orders a file's lines as their
number would.  For every range of bytes read there is a row without a value that says that all lines from ``line_no`` to ``upto`` have been
handed out; by it a consumer knows what it still waits for, in whatever order ranges arrive (:mod:`turnwise.streaming.whole_fold`).

Long files are cut into ranges of ``block_bytes`` and short ones put together, so tasks are even; a range holds the lines that start in it.
Manifests are files in the folder ``positions``, which driver, tasks and checkpoint share.  They are sorted by path, and the driver reads the last one
beside the sorted listing and writes the next one as it goes; what each task reads is written beside them too.  So the driver holds a bounded
number of files at a time (``SORTED_ROWS``), however many there are; per changed file it reads some kilobytes at both ends.

    tail.register(spark)
    lines = tail.stream_lines(spark, "/logs/projects", "*/*.jsonl", positions="/checkpoints/positions")
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import os
import pickle
import re
import stat
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from glob import translate
from itertools import batched, chain, groupby, islice
from operator import itemgetter

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "line_tail"
SCHEMA = "path STRING, generation BIGINT, line_no BIGINT, upto BIGINT, value STRING"
HEAD_BYTES, TAIL_BYTES, STEP_BYTES = 4096, 256, 1 << 16
BLOCK_BYTES = 8 << 20
BATCH_BYTES = 2 << 20
SORTED_ROWS, STEP_ROWS = 20_000, 500  # files held while sorting, and of each run while merging


@dataclass(frozen=True)
class Seen:
    """What is known of a file: bytes before ``at`` were handed out."""

    generation: int
    at: int
    head_bytes: int
    head: str
    tail: str
    size: int  # as listed; -1 where lines were left for the next batch
    modified: int


def _open(root: str) -> tuple[pa.fs.FileSystem, str, str]:
    """The store, the folder in it, and what comes before a path of the store in the names that Spark's file sources give."""
    local = "://" not in root or root.startswith("file://")
    if local:
        root = "file://" + root.removeprefix("file://").removeprefix("file:")
    store, base = pa.fs.FileSystem.from_uri(root)
    root, base = root.rstrip("/"), base.rstrip("/")
    return store, base, "file:" if local else root.removesuffix(base)


def _digest(file, start: int, end: int) -> str:
    start = max(0, start)
    file.seek(start)
    return hashlib.sha256(file.read(end - start)).hexdigest()[:32]


def _line_end(file, low: int, high: int) -> int:
    """The end of the last whole line that ends in (low, high]; ``low`` if none does."""
    while high > low:
        start = max(low, high - STEP_BYTES)
        file.seek(start)
        cut = file.read(high - start).rfind(b"\n")
        if cut >= 0:
            return start + cut + 1
        high = start
    return low


def look(store: pa.fs.FileSystem, path: str, size: int, modified: int, before: Seen | None, most: int | None = None) -> Seen | None:
    """The file's next position, at most ``most`` bytes on where lines are not longer than that; None if the file is gone."""
    if before and before.size == size and before.modified == modified:
        return before
    try:
        with store.open_input_file(path) as file:
            if size <= STEP_BYTES:  # one read of a short file serves all that follows
                file = io.BytesIO(file.read())
            same = before is not None and size >= before.at and _digest(file, 0, before.head_bytes) == before.head and _digest(file, before.at - TAIL_BYTES, before.at) == before.tail
            start = before.at if same else 0
            end = _line_end(file, start, size)
            left = most is not None and end - start > most
            if left:
                end = _line_end(file, start, start + most) if _line_end(file, start, start + most) > start else end
            generation = before.generation if same else before.generation + 1 if before else 0
            head = min(HEAD_BYTES, end)
            return Seen(generation, end, head, _digest(file, 0, head), _digest(file, end - TAIL_BYTES, end), -1 if left else size, modified)
    except OSError:
        return before


@dataclass
class Ranges(InputPartition):
    """The ranges of one task: a line of a file beside the manifests, which the task reads."""

    positions: str
    name: str
    at: int
    size: int

    @property
    def ranges(self) -> list[tuple[str, int, int, int, bool]]:
        """(path in the store, generation, first byte, end, whether a line starts there)"""
        store, base, _ = _open(self.positions)
        with store.open_input_file(f"{base}/{self.name}") as file:
            file.seek(self.at)
            return [tuple(r) for r in json.loads(file.read(self.size))]


def walk(store: pa.fs.FileSystem, folder: str) -> Iterator[tuple[str, tuple[int, int]]]:
    """(path, (size, modified)) of all files below a folder.  Of a local one the entries are taken as they come, other stores list in one call."""
    if not isinstance(store, pa.fs.LocalFileSystem):
        for f in store.get_file_info(pa.fs.FileSelector(folder, recursive=True, allow_not_found=True)):
            if f.is_file:
                yield f.path, (f.size, f.mtime_ns or 0)
        return
    try:
        entries = os.scandir(folder or "/")
    except FileNotFoundError:
        return
    with entries:
        for entry in entries:
            try:
                found = entry.stat()
            except FileNotFoundError:  # gone meanwhile
                continue
            if stat.S_ISDIR(found.st_mode):
                yield from walk(store, f"{folder}/{entry.name}")
            elif stat.S_ISREG(found.st_mode):
                yield f"{folder}/{entry.name}", (found.st_size, found.st_mtime_ns)


def ordered(rows: Iterable[tuple], key: Callable) -> Iterator[tuple]:
    """The rows in order.  At most ``SORTED_ROWS`` are held, more wait in temporary files of this process."""
    rows, runs = iter(rows), []
    while part := sorted(islice(rows, SORTED_ROWS), key=key):
        if not runs and len(part) < SORTED_ROWS:
            yield from part
            return
        run = tempfile.TemporaryFile()
        for start in range(0, len(part), STEP_ROWS):
            pickle.dump(part[start : start + STEP_ROWS], run)
        run.seek(0)
        runs.append(run)
    yield from heapq.merge(*map(_read_run, runs), key=key)


def _read_run(run) -> Iterator[tuple]:
    with run:
        while True:
            try:
                yield from pickle.load(run)
            except EOFError:
                return


def beside(left: Iterable[tuple], right: Iterable[tuple]) -> Iterator[tuple]:
    """(path, left's, right's) of two runs of (path, value) in order of paths; None where one lacks the path."""
    both = heapq.merge(((path, 0, x) for path, x in left), ((path, 1, x) for path, x in right), key=itemgetter(0, 1))
    for path, same in groupby(both, itemgetter(0)):
        found = {side: x for _, side, x in same}
        yield path, found.get(0), found.get(1)


def cut(before: Iterable[tuple[str, Seen]], after: Iterable[tuple[str, Seen]], block: int) -> Iterator[list[tuple]]:
    """The bytes between two manifests in parts of about ``block`` bytes, each a list of ranges (see :class:`Ranges`)."""
    held, size = [], 0
    for path, known, seen in beside(before, after):
        if seen is None:
            continue
        low = start = known.at if known and known.generation == seen.generation else 0
        while low < seen.at:
            high = min(low + block, seen.at)
            held.append((path, seen.generation, low, high, low == start))
            size += high - low
            low = high
            if size >= block:
                yield held
                held, size = [], 0
    if held:
        yield held


def lines_between(file, low: int, high: int, aligned: bool) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of the whole lines that start in [low, high)."""
    at = low
    file.seek(low if aligned else low - 1)
    if not aligned:
        at = low - 1 + len(file.readline())
    while at < high:
        line = file.readline()
        if not line.endswith(b"\n"):
            return
        yield at, line
        at += len(line)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "generation", "line_no", "upto", "value"])


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.pattern, self.positions = options["path"], options.get("pattern", "*"), options["positions"]
        self.block = int(options.get("block_bytes", BLOCK_BYTES))
        self.most = int(options["max_bytes"]) if "max_bytes" in options else None

    # -- manifests

    def _manifest(self, offset: dict) -> Iterator[tuple[str, Seen]]:
        """(path, position) in order of paths."""
        if not offset.get("id"):
            return
        store, base, _ = _open(self.positions)
        with io.TextIOWrapper(io.BufferedReader(store.open_input_file(f"{base}/{offset['n']:012d}-{offset['id']}.json"), 1 << 20), "utf-8") as file:
            for row in map(json.loads, file):
                if isinstance(row, dict):  # as written by earlier versions, all files in one line
                    yield from sorted(((path, Seen(**seen)) for path, seen in row.items()), key=itemgetter(0))
                else:
                    yield row[0], Seen(*row[1:])

    def _manifests(self) -> list[dict]:
        """Offsets of the manifests there are, oldest first."""
        store, base, _ = _open(self.positions)
        found = store.get_file_info(pa.fs.FileSelector(base, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.base_name.endswith(".json"))
        return [{"n": int(name[:12]), "id": name[13:-5]} for name in names]

    def _write(self, n: int, rows: Iterable[tuple[str, Seen | None, Seen | None]]) -> dict | None:
        """A manifest of (path, position, the one before) in order of paths; None, and none, if no position is another."""
        store, base, _ = _open(self.positions)
        store.create_dir(base, recursive=True)
        offset, changed = {"n": n, "id": uuid.uuid4().hex}, False
        target = f"{base}/{n:012d}-{offset['id']}"
        with io.BufferedWriter(store.open_output_stream(f"{target}.tmp"), 1 << 20) as out:
            for path, seen, before in rows:
                changed |= seen != before
                if seen is not None:
                    out.write(json.dumps([path, *vars(seen).values()]).encode() + b"\n")
        if not changed:
            store.delete_file(f"{target}.tmp")
            return None
        store.move(f"{target}.tmp", f"{target}.json")
        return offset

    # -- the source

    def initialOffset(self) -> dict:
        return {"n": 0, "id": ""}

    def latestOffset(self) -> dict:
        known = self._manifests()
        last = known[-1] if known else self.initialOffset()
        store, base, _ = _open(self.root)
        fits = re.compile(translate(self.pattern, recursive=True, include_hidden=True)).match
        listed = ordered((f for f in walk(store, base) if fits(f[0].removeprefix(base).lstrip("/"))), itemgetter(0))
        rows = beside(listed, self._manifest(last))
        if self.most is None:
            rows = self._looked(store, rows)
        else:  # the files that were changed first have the budget first
            rows = ordered(rows, lambda r: (r[1] is None, r[1][1] if r[1] else 0, r[0]))
            rows = ordered(self._looked(store, rows), itemgetter(0))
        return self._write(last["n"] + 1, rows) or last

    def _looked(self, store: pa.fs.FileSystem, rows: Iterable[tuple]) -> Iterator[tuple[str, Seen | None, Seen | None]]:
        """(path, next position, the one before) of (path, (size, modified) if listed, the one before)."""
        budget = self.most
        with ThreadPoolExecutor(16) as pool:
            for part in batched(rows, 256):  # files looked at together; with a budget, those of a step share what is left
                spent = budget is not None and budget <= 0
                there = [r for r in part if r[1] and not spent]
                share = None if budget is None else max(1, budget // max(1, len(there)))
                found = dict(zip((r[0] for r in there), pool.map(lambda r: look(store, r[0], *r[1], r[2], share), there), strict=True))  # noqa: B023
                for path, _, old in part:
                    seen = found.get(path) or old
                    if budget is not None and seen is not None:
                        budget -= seen.at - (old.at if old and old.generation == seen.generation else 0)
                    yield path, seen, old

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        store, base, _ = _open(self.positions)
        out, name, at = [], f"{end['n']:012d}-{end['id']}-{start['n']}.plan", 0
        parts = cut(self._manifest(start), self._manifest(end), self.block)
        first = next(parts, None)
        if first is None:
            return out
        draft = f"{base}/{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(draft) as file:
            for part in chain([first], parts):
                line = json.dumps(part).encode() + b"\n"
                file.write(line)
                out.append(Ranges(self.positions, name, at, len(line)))
                at += len(line)
        store.move(draft, f"{base}/{name}")
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _, prefix = _open(self.root)
        rows, size = [], 0
        for path, generation, low, high, aligned in partition.ranges:
            uri = prefix + path
            with io.BufferedReader(store.open_input_file(path), 1 << 20) as file:
                for at, line in lines_between(file, low, high, aligned):
                    value = line.rstrip(b"\r\n")
                    if value:
                        rows.append((uri, generation, at, None, value.decode("utf-8", "replace")))
                        size += len(value)
                    if size >= BATCH_BYTES:
                        yield _rows(rows)
                        rows, size = [], 0
            rows.append((uri, generation, low, high, None))
        if rows:
            yield _rows(rows)

    def commit(self, end: dict) -> None:
        """Earlier manifests, and what was planned up to this one, are not needed any more."""
        store, base, _ = _open(self.positions)
        for offset in self._manifests():
            if offset["n"] < end["n"]:
                store.delete_file(f"{base}/{offset['n']:012d}-{offset['id']}.json")
        for f in store.get_file_info(pa.fs.FileSelector(base, allow_not_found=True)):
            if f.base_name.endswith(".plan") and int(f.base_name[:12]) <= end["n"]:
                store.delete_file(f.path)


class TailSource(DataSource):
    """Options: path, pattern (of paths below it), positions, block_bytes, max_bytes (a batch reads about so much)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def read_paths(paths: DataFrame, root: str, block: int = BLOCK_BYTES) -> DataFrame:
    """All lines ``(path, line_no, value)``, numbered as the stream numbers them, of files below ``root`` that a column ``path`` names.

    Long files are read by many tasks; a file that is gone has no lines.
    """

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _, prefix = _open(root)
        for batch in batches:
            named = batch.column("path").to_pylist()
            sizes = [f.size or 0 for f in store.get_file_info([p.removeprefix(prefix) for p in named])] if named else []
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], names=["path", "size"])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _, prefix = _open(root)
        for batch in batches:
            for path, low, high in zip(*(batch.column(c).to_pylist() for c in ("path", "low", "high")), strict=True):
                rows, size = [], 0
                with io.BufferedReader(store.open_input_file(path.removeprefix(prefix)), 1 << 20) as file:
                    for at, line in lines_between(file, low, high, low == 0):
                        value = line.rstrip(b"\r\n")
                        if value:
                            rows.append((path, at, value.decode("utf-8", "replace")))
                            size += len(value)
                        if size >= BATCH_BYTES:
                            yield _lines(rows)
                            rows, size = [], 0
                if rows:
                    yield _lines(rows)

    blocks = paths.select("path").distinct().mapInArrow(sized, "path STRING, size BIGINT").where("size > 0")
    blocks = blocks.select("path", "size", F.explode(F.expr(f"sequence(0L, size - 1, {block}L)")).alias("low"))
    blocks = blocks.select("path", "low", F.least(F.col("low") + block, F.col("size")).alias("high"))
    return blocks.repartition("path", "low").mapInArrow(lines, "path STRING, line_no BIGINT, value STRING")


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "line_no", "value"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)


def stream_lines(spark: SparkSession, root: str, pattern: str, positions: str, max_bytes: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Added lines and covered ranges of the files below ``root`` whose path matches ``pattern``."""
    register(spark)
    reader = spark.readStream.format(FORMAT).option("path", root).option("pattern", pattern).option("positions", positions).option("block_bytes", block_bytes)
    return (reader if max_bytes is None else reader.option("max_bytes", max_bytes)).load()
