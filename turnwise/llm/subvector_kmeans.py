"""Centroid clustering over dictionaries of subvectors, in exact integers.

A vector of integers is cut into blocks of ``WIDTH`` components.  For every block, the vectors of a chunk (a bounded run of one
partition's rows) are written as a dictionary of the block's distinct subvectors and one code per vector: nothing is lost, and what was
encoded once serves all rounds.  A round then needs, per block, the squared distance of every *distinct* subvector to every centroid's
block, once; a vector's distance is the sum of its codes' partial distances over the blocks.  The update goes by codes as well: how often a
code fell to a cluster, times its subvector.

Encoded chunks are a table in the shared folder; each round reads it, a lost executor's chunks are read again, and no vector is shuffled
after the first pass.  A task hands out at most one row per centroid and round; those are summed in Spark, and ``k`` sums (``k`` and the
number of components are parameters) reach the driver, which divides them exactly.  Centroids go to the tasks the same way: ``k`` rows of
integers.  A task holds one chunk, its dictionaries, and ``CHUNK x k`` distances.

Assignment: nearest centroid by squared Euclidean distance, ties to the smaller number.  Update: floor(sum / count) per component; a centroid
without vectors stays.

Defined results: vectors that are null, of another length, or hold a null or a value that is not finite are left out; repeated rows are
vectors of their own; a null id is hashed as an empty text; fewer vectors than ``k`` make as many centroids as there are vectors; without
vectors there are no rows.  Components beyond ``LARGEST`` in size would overflow a 64-bit distance and raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import materialize

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2"
WIDTH = 2  # components of a block
CHUNK = 16_384  # vectors that share dictionaries
LARGEST = 2**27

_ENCODED = "ids array<bigint>, n bigint, sizes array<int>, dictionaries binary, codes binary"


def integers(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, v): every complete vector as integers floor(scale * component)."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    whole = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fits = F.forall("v", lambda x: F.abs(x) <= LARGEST)
    kept = table.where(v.isNotNull() & whole).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))
    return kept.withColumn("v", F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST}"))))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: str = SEED) -> list[list[int]]:
    """The ``k`` vectors whose ``seed:id`` has the smallest SHA-256; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r.v) for r in vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()]


# ---------------------------------------------------------------- inside tasks

def encode(vectors: np.ndarray, width: int = WIDTH) -> tuple[list[np.ndarray], np.ndarray]:
    """Per block its distinct subvectors, and the codes (block, vector); ``dictionaries[b][codes[b]]`` is block b again."""
    blocks = [vectors[:, at : at + width] for at in range(0, vectors.shape[1], width)]
    found = [np.unique(block, axis=0, return_inverse=True) for block in blocks]
    return [d for d, _ in found], np.array([c.reshape(-1) for _, c in found], dtype=np.int32).reshape(len(blocks), len(vectors))


def distances(dictionaries: list[np.ndarray], codes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (vector, centroid): each distinct subvector is measured once, and vectors add up what their codes say."""
    total, at = np.zeros((codes.shape[1], len(centroids)), dtype=np.int64), 0
    for subvectors, code in zip(dictionaries, codes, strict=True):
        own = centroids[:, at : at + subvectors.shape[1]]
        at += subvectors.shape[1]
        partial = np.zeros((len(subvectors), len(centroids)), dtype=np.int64)
        for j in range(subvectors.shape[1]):
            gap = subvectors[:, j : j + 1] - own[None, :, j]
            partial += gap * gap
        total += partial[code]
    return total


def sums(dictionaries: list[np.ndarray], codes: np.ndarray, clusters: np.ndarray, k: int) -> np.ndarray:
    """Component sums (cluster, component): the count of each code in each cluster times its subvector."""
    found = []
    for subvectors, code in zip(dictionaries, codes, strict=True):
        held = np.bincount(code.astype(np.int64) * k + clusters, minlength=len(subvectors) * k).reshape(len(subvectors), k)
        found.append(held.T.astype(np.int64) @ subvectors)
    return np.concatenate(found, axis=1)


def _encoder(width: int, chunk: int):
    def pack(ids: list, rows: list[np.ndarray]) -> pa.RecordBatch:
        dictionaries, codes = encode(np.concatenate(rows), width)
        columns = [
            pa.array([ids], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([[len(d) for d in dictionaries]], pa.list_(pa.int32())),
            pa.array([b"".join(d.astype("<i8").tobytes() for d in dictionaries)], pa.binary()), pa.array([codes.astype("<i4").tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "n", "sizes", "dictionaries", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            for start in range(0, batch.num_rows, chunk):
                part = batch.slice(start, chunk)
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
                if len(ids) + part.num_rows > chunk and ids:
                    yield pack(ids, rows)
                    ids, rows = [], []
                ids += part.column("id").to_pylist()
                rows.append(flat.reshape(part.num_rows, -1))
        if ids:
            yield pack(ids, rows)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch], dimensions: int, width: int) -> Iterator[tuple[pa.Array, list[np.ndarray], np.ndarray]]:
    widths = [min(width, dimensions - at) for at in range(0, dimensions, width)]
    for batch in batches:
        for i in range(batch.num_rows):
            sizes = batch.column("sizes")[i].as_py()
            values = np.frombuffer(batch.column("dictionaries")[i].as_buffer(), "<i8")
            codes = np.frombuffer(batch.column("codes")[i].as_buffer(), "<i4").reshape(len(widths), -1)
            edges = np.cumsum([0, *(s * w for s, w in zip(sizes, widths, strict=True))])
            dictionaries = [values[a:b].reshape(-1, w) for a, b, w in zip(edges[:-1], edges[1:], widths, strict=True)]
            yield batch.column("ids")[i].values, dictionaries, codes


def _round(centroids: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dimensions = centroids.shape
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dimensions), dtype=np.int64)
        for _, dictionaries, codes in _unpacked(batches, dimensions, width):
            nearest = distances(dictionaries, codes, centroids).argmin(axis=1)
            count += np.bincount(nearest, minlength=k)
            total += sums(dictionaries, codes, nearest, k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(count[used], pa.int64()), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
        )

    return run


def _assigner(centroids: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, dictionaries, codes in _unpacked(batches, centroids.shape[1], width):
            found = distances(dictionaries, codes, centroids)
            nearest = found.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(nearest, pa.int32()), pa.array(found[np.arange(len(nearest)), nearest], pa.int64())], names=["id", "cluster", "distance"]
            )

    return run


# ---------------------------------------------------------------- on Spark

@dataclass(frozen=True)
class Clustering:
    """``rows`` (id, cluster, distance) of every vector, and the final centroids (at most ``k``)."""

    rows: DataFrame
    centroids: list[list[int]]


def encoded(vectors: DataFrame, name: str, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """Chunks of the vectors as dictionaries and codes, written to the shared folder."""
    return materialize(vectors.mapInArrow(_encoder(width, chunk), _ENCODED), f"{name}_encoded")


def moved(chunks: DataFrame, centroids: list[list[int]], width: int = WIDTH) -> list[list[int]]:
    """The centroids after one round."""
    at = np.array(centroids, dtype=np.int64)
    parts = chunks.mapInArrow(_round(at, width), "cluster int, n bigint, sums array<bigint>")
    cells = parts.select("cluster", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "value"))
    after = [list(c) for c in centroids]
    held: dict[int, dict[int, int]] = {}
    for r in cells.groupBy("cluster", "at").agg(F.sum("value").alias("value")).collect():  # at most k x (components + 1) rows
        held.setdefault(r.cluster, {})[r.at] = r.value
    for cluster, found in held.items():
        after[cluster] = [found[i + 1] // found[0] for i in range(at.shape[1])]
    return after


def cluster(vectors: DataFrame, name: str, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, chunk: int = CHUNK, seed: str = SEED) -> Clustering:
    """Cluster ``vectors`` (id, v) around at most ``k`` centroids."""
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return Clustering(vectors.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).where("false"), [])
    chunks = encoded(vectors, name, width, chunk)
    for _ in range(rounds):
        centroids = moved(chunks, centroids, width)
    rows = chunks.mapInArrow(_assigner(np.array(centroids, dtype=np.int64), width), "id bigint, cluster int, distance bigint")
    return Clustering(materialize(rows, f"{name}_rows"), centroids)


def fingerprint(centroid: list[int]) -> str:
    """SHA-256 of a centroid's components as decimals, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def inertia(found: Clustering) -> DataFrame:
    """(cluster, cluster_inertia, inertia, centroid_sha256), one row per used centroid."""
    spark = found.rows.sparkSession
    held = found.rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # at most k rows
    whole = sum(r.cluster_inertia for r in held)
    marks = [(r.cluster, r.cluster_inertia, whole, fingerprint(found.centroids[r.cluster])) for r in held]
    return spark.createDataFrame(marks, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
