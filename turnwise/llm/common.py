"""What the corpus operators share: reading, words, written tables, connected components."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.session import configure, discard, materialize

__all__ = [
    "arrow_rows", "components", "discard", "hold", "let", "list_column", "materialize", "maybe_in", "md5_unit", "prepare", "read",
    "same_row", "shingles", "word_hashes", "words_of",
]

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: White space that separates words everywhere in this package: space, and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"


#: Texts in one Arrow batch; whole texts are long, and Spark's default of 10,000 would hold tens of MB several times over.
BATCH_ROWS = "512"


def prepare(spark: SparkSession) -> None:
    """Session settings, this package on the path of the Python workers, and small batches for them."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    # Shuffle files go when the table they were for is written; else they stay until the driver happens to collect its garbage.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    given = spark.sparkContext.environment
    if _ROOT not in given.get("PYTHONPATH", "").split(os.pathsep):
        given["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, given.get("PYTHONPATH", "")) if x)
    # Freed batches go back to the system instead of staying in the worker's pools.
    given.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    given.setdefault("MALLOC_ARENA_MAX", "2")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` reads it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def md5_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts' text; the same in any engine that has MD5."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def same_row(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of the named columns, a null being equal to a null."""
    found = F.lit(True)
    for name in names:
        found = found & left[name].eqNullSafe(right[name])
    return found


# ---------------------------------------------------------------- inside tasks

_HELD: dict = {"owner": None, "free": None}


def hold(owner: str, free) -> None:
    """Say whose tables this Python worker keeps from now on; those of another operator, which ran in it before, are freed."""
    if _HELD["owner"] != owner:
        if _HELD["free"]:
            _HELD["free"]()
        _HELD.update(owner=owner, free=free)


class _WordHashes(dict):
    """64-bit hash of each word; emptied when it has grown large, so memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text, A-Z lower-cased."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    hold("shingles", _HASHES.clear)
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``width`` words; a shorter text is one run, no words are none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(words)
    span = min(width, len(words))
    m = len(words) - span + 1
    acc = h[:m] ^ np.uint64(span)
    for j in range(1, span):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + m]
        acc ^= acc >> np.uint64(29)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(acc ^ (acc >> np.uint64(32)))


def list_column(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def arrow_rows(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller slices of the batches, where the session was set up for large ones."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


# ---------------------------------------------------------------- look-ups without a shuffle of what is looked up

PAGE_BITS = 1 << 16
MOST_PAGES = 1 << 11  # a filter of 16 MB; a full one only lets more values through
_KEY_BITS, _PROBES = 16, 4


def _bits_of(h: np.ndarray) -> np.ndarray:
    """The bits (value, probe) within a page of 64-bit hashes."""
    step = (h >> np.uint64(17)) | np.uint64(1)
    return ((h[:, None] + np.arange(_PROBES, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(PAGE_BITS)).astype(np.int64)


def _page_of(h: Column, pages: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 34), F.lit(pages)).cast("int")


def maybe_in(values: DataFrame) -> Callable[[Column], Column]:
    """A test that is true for all values of the one column of ``values`` and for few others, a null being a value.

    It is a Bloom filter in pages, each made by one task; tasks get all of it, so wide rows can be told apart where they are read.
    What passes is looked up exactly afterwards.
    """
    spark = values.sparkSession
    marks = values.select(F.xxhash64(F.lit(1), values.columns[0]).alias("h"))
    pages = min(MOST_PAGES, max(1, -(-marks.count() * _KEY_BITS // PAGE_BITS)))

    def filled(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = np.zeros(PAGE_BITS // 8, dtype=np.uint8)
        for batch in batches:
            at = _bits_of(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)).ravel()
            np.bitwise_or.at(page, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([page.tobytes()], pa.binary())], names=["page", "bits"])

    made = marks.withColumn("page", _page_of(F.col("h"), pages)).groupBy("page").applyInArrow(filled, "page int, bits binary").collect()
    field = bytearray(pages * (PAGE_BITS // 8))
    for page, bits in made:
        field[page * len(bits) : (page + 1) * len(bits)] = bits
    shared = spark.sparkContext.broadcast(bytes(field))

    @F.arrow_udf("boolean")
    def known(h: pa.Array, page: pa.Array) -> pa.Array:
        bits = np.frombuffer(shared.value, dtype=np.uint8)
        at = _bits_of(h.to_numpy(zero_copy_only=False).view(np.uint64)) + page.to_numpy(zero_copy_only=False).astype(np.int64)[:, None] * PAGE_BITS
        return pa.array(np.all(bits[at >> 3] & (1 << (at & 7)).astype(np.uint8), axis=1))

    def test(value: Column) -> Column:
        h = F.xxhash64(F.lit(1), value)
        return known(h, _page_of(h, pages))

    return test


# ---------------------------------------------------------------- components

def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges(a, b)`` as (node, component), the component being its smallest node.

    Alternating star contraction: every node's larger neighbours are tied to its smallest neighbour, then its smaller
    ones, until nothing changes.  Each round is two aggregates and two joins on narrow rows and is written to the shared
    folder, so lineage stays short; rounds grow with the logarithm of the graph.  Smallest neighbours are written before they are
    looked up, so that a node with very many edges is split between tasks.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}_e0")
    before = None
    for step in range(1, 100):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"{name}_low{step}")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Now a > b in every row; tie each node's smaller neighbours to the smallest of them.
        large = materialize(large, f"{name}_large{step}")
        discard(low)
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}_least{step}")
        small = large.join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("b")).select(F.col("x").alias("a"), "b").unionByName(
            low.select("a", F.col("m").alias("b"))
        ).where("a <> b").distinct()
        earlier, edges = edges, materialize(small, f"{name}_e{step}")
        discard(earlier, large, low)
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"{name}: the components have not settled after 99 rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

