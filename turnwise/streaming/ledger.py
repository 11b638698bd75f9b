"""Ids counted once for ever: a ledger of ids in written tables instead of streaming state.

``dropDuplicates`` keeps every id in state without a watermark and forgets ids with one.  Here the ids seen lie in buckets of their hash, and
for each bucket there is a Bloom filter.  A micro-batch's ids are tested against the filters of their buckets; only those that a filter may know are
looked up in the ledger, and only in the buckets they fall into.  Most ids of a batch are new, so most of the ledger is not read.

Each batch adds a part to the buckets it touches; a bucket of ``MOST_PARTS`` parts is written together.  Filters and parts are named by one snapshot
(:mod:`turnwise.sources.snapshots`), after which the batch is known: run again, it finds its own ids under its name and gives the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.session import materialize
from turnwise.sources import snapshots

IDS, FILTERS = "ids", "filters"
MOST_PARTS = 8
BITS = 1 << 20  # of a bucket's filter; a full one only lets more ids through to the look-up
_PROBES = 4


def bits_of(h: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The filter positions (id, probe) of 64-bit hashes."""
    h = h.view(np.uint64)
    step = (h >> np.uint64(33)) | np.uint64(1)
    return ((h[:, None] + np.arange(_PROBES, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(bits)).astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's filter and hashes, from rows that hold the one or the other."""
    field, found = np.zeros(BITS // 8, dtype=np.uint8), [np.empty(0, dtype=np.int64)]
    for batch in batches:
        for held in batch.column("filter").drop_null().to_pylist():
            field |= np.frombuffer(held, dtype=np.uint8)
        found.append(batch.column("h").drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
    return field, np.concatenate(found)


def _tested(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of a bucket that its filter may know."""
    field, h = _gathered(batches)
    at = bits_of(h)
    may = np.all(field[at >> 3] & (1 << (at & 7)).astype(np.uint8), axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(h[may], pa.int64())], names=["h"])


def _filled(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's filter with its hashes in it."""
    field, h = _gathered(batches)
    at = bits_of(h).ravel()
    np.bitwise_or.at(field, at >> 3, (1 << (at & 7)).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([field.tobytes()], pa.binary())], names=["bucket", "filter"])


def _with_filters(rows: DataFrame, filters: DataFrame | None) -> DataFrame:
    """(bucket, filter, h): hashes of the rows, and the filters there are."""
    marks = rows.select(F.col("__bucket").alias("bucket"), F.lit(None).cast("binary").alias("filter"), F.col("__h").alias("h"))
    return marks if filters is None else marks.unionByName(filters.withColumn("h", F.lit(None).cast("bigint")))


class Ledger:
    """The ids that ``owner``'s batches have brought, in the folder ``root``."""

    def __init__(self, root: str, owner: str, keys: list[str], buckets: int = 64):
        self.root, self.owner, self.keys, self.buckets = root, owner, keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def fresh(self, batch: DataFrame, batch_id: int, order: list[str]) -> DataFrame:
        """One row of the batch, the first by ``order``, for each id that no earlier batch had; the ids are noted.

        Rows with a null among their keys have no id and all pass.
        """
        spark = batch.sparkSession
        named = F.lit(True)
        for key in self.keys:
            named = named & F.col(key).isNotNull()
        loose, batch = batch.where(~named), batch.where(named)
        first = batch.groupBy(*self.keys).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("row")).select("row.*")
        first = materialize(first.withColumn("__bucket", self._bucket()).withColumn("__h", F.xxhash64(F.lit(1), *self.keys)), "ledger_batch")
        before = snapshots.current(spark, self.root, self.owner)
        known = self._known(first, before, batch_id)
        rows = first if known is None else first.join(known, self.keys, "left_anti")
        rows = materialize(rows, "ledger_fresh")
        if before.batch is None or int(before.batch) < batch_id:
            self._note(rows, before, batch_id)
        return rows.drop("__bucket", "__h").unionByName(loose)

    def _known(self, first: DataFrame, before: snapshots.Snapshot, batch_id: int) -> DataFrame | None:
        """Ids of the batch that the ledger has from other batches."""
        spark = first.sparkSession
        if IDS not in before.parts:
            return None
        filters = snapshots.read(spark, before, FILTERS)
        may = _with_filters(first, filters).groupBy("bucket").applyInArrow(_tested, "h bigint")
        may = materialize(may.select(F.col("h").alias("__h")).distinct(), "ledger_maybe")
        asked = materialize(first.join(may, "__h", "left_semi").select(*self.keys, "__bucket"), "ledger_asked")
        touched = {r[0] for r in asked.select("__bucket").distinct().collect()}  # at most ``buckets``
        folders = [folder for part, folder in before.parts[IDS].items() if int(part.split("/")[0]) in touched]
        if not folders:
            return None
        held = spark.read.schema(snapshots.schema_of(before, IDS)).parquet(*folders).where(F.col("batch") != batch_id)
        return held.join(asked.select(*self.keys), self.keys, "left_semi").select(*self.keys)

    def _note(self, rows: DataFrame, before: snapshots.Snapshot, batch_id: int) -> None:
        spark = rows.sparkSession
        ids = rows.select(*self.keys, F.lit(batch_id).cast("bigint").alias("batch"), "__bucket")
        held, touched = dict(before.parts.get(IDS, {})), [r[0] for r in rows.select("__bucket").distinct().collect()]
        folder = f"{self.root}/{self.owner}/{IDS}/{uuid.uuid4().hex}"
        full = [b for b in touched if sum(part.split("/")[0] == str(b) for part in held) >= MOST_PARTS]
        together = [folder for part, folder in held.items() if int(part.split("/")[0]) in full]
        if together:
            old = spark.read.schema(snapshots.schema_of(before, IDS)).parquet(*together)
            ids = ids.unionByName(old.withColumn("__bucket", self._bucket()))
            held = {part: at for part, at in held.items() if int(part.split("/")[0]) not in full}
        ids.repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
        held |= {f"{b}/{batch_id}": f"{folder}/__bucket={b}" for b in touched}
        filters = snapshots.read(spark, before, FILTERS)
        filled = _with_filters(rows, filters).groupBy("bucket").applyInArrow(_filled, "bucket int, filter binary")
        parts = {IDS: held, FILTERS: snapshots.write_part(filled, self.root, self.owner, FILTERS)}
        schemas = {IDS: ids.drop("__bucket").schema.json(), FILTERS: filled.schema.json()}
        snapshots.commit(spark, self.root, before, parts, schemas, str(batch_id))
