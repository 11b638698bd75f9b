"""Tables that change as one: data in folders that are never touched again, and a manifest that says which of them count.

A publisher writes new folders first and its manifest last, a file of one row that names, for every table, the folder of each part (and the
table's schema, so an empty table can be read).  The newest manifest is the snapshot; readers see all of one or all of the one before.  What did
not change keeps its folder.  Each owner (a machine) has manifests of its own and cannot touch another's; a batch that is replayed finds its name in
the manifest and is not published again, and a restart finds the last content's identity there.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise import fixed
from turnwise.session import materialize
from turnwise.sources.sinks import content_hash
from turnwise.sources.transcripts import if_there

MANIFEST = "owner STRING, version BIGINT, batch STRING, digest STRING, at STRING, parts MAP<STRING, MAP<STRING, STRING>>, schemas MAP<STRING, STRING>"
WHOLE = "all"


@dataclass(frozen=True)
class Snapshot:
    owner: str
    version: int = 0
    batch: str | None = None
    digest: str | None = None
    at: str | None = None
    parts: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)


def schema_of(s: Snapshot, table: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(s.schemas[table]))


def _manifests(spark: SparkSession, root: str, owner: str = "*") -> DataFrame:
    found = if_there(lambda: spark.read.schema(MANIFEST).json(f"{root}/{owner}/_snapshots"))
    return spark.createDataFrame([], MANIFEST) if found is None else found


def current(spark: SparkSession, root: str, owner: str) -> Snapshot:
    """The owner's newest snapshot; one without tables before the first."""
    newest = _manifests(spark, root, owner).orderBy(F.desc("version")).limit(1).collect()
    return Snapshot(**newest[0].asDict(recursive=True)) if newest else Snapshot(owner)


def owners(spark: SparkSession, root: str) -> list[Snapshot]:
    """The newest snapshot of every owner (one row each)."""
    rows = _manifests(spark, root).groupBy("owner").agg(F.max_by(F.struct("version", "batch", "digest", "at", "parts", "schemas"), "version").alias("s"))
    return [Snapshot(r.owner, **r.s.asDict(recursive=True)) for r in rows.orderBy("owner").collect()]


def intact(spark: SparkSession, s: Snapshot) -> bool:
    """Whether every file of the snapshot is there and opens (their footers are read, one job a table)."""
    try:
        for table in s.parts:
            read(spark, s, table).count()
    except (PySparkException, Py4JJavaError):
        return False
    return True


def write_part(df: DataFrame, root: str, owner: str, table: str) -> dict[str, str]:
    """A table as one folder of its own."""
    folder = f"{root}/{owner}/{table}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return {WHOLE: folder}


def commit(spark: SparkSession, root: str, before: Snapshot, parts: dict[str, dict[str, str]], schemas: dict[str, str], batch: str | None = None, digest: str | None = None, now: datetime | None = None) -> Snapshot:
    """The next snapshot: the tables given, and the others as they were.  One row in one file, so it is there whole or not at all."""
    after = Snapshot(before.owner, before.version + 1, batch, digest, now and now.isoformat(), {**before.parts, **parts}, {**before.schemas, **schemas})
    row = spark.createDataFrame([tuple(getattr(after, f) for f in ("owner", "version", "batch", "digest", "at", "parts", "schemas"))], MANIFEST)
    row.coalesce(1).write.mode("append").json(f"{root}/{before.owner}/_snapshots")
    return after


def read(spark: SparkSession, snapshots: Snapshot | list[Snapshot], table: str) -> DataFrame | None:
    """A table of one or more snapshots; columns that only some have are null elsewhere.  None if none has it."""
    found = []
    for s in [snapshots] if isinstance(snapshots, Snapshot) else snapshots:
        if table in s.parts:
            folders = list(s.parts[table].values())
            found.append(spark.read.schema(schema_of(s, table)).parquet(*folders) if folders else spark.createDataFrame([], schema_of(s, table)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found) if found else None


def publish(tables: dict[str, DataFrame], root: str, owner: str, now: datetime, batch: str | None = None, heartbeat: int = fixed.HEARTBEAT_SECONDS, ignore: tuple[str, ...] = ("generated_utc",)) -> Snapshot:
    """Publish tables together when their content changed or the heartbeat is due; give the snapshot that holds then.

    Every table is computed once: it is written, its identity is taken from what was written, and the folder is named only if it counts.
    A table without rows is published as such, so what an owner no longer has is gone.
    """
    spark = next(iter(tables.values())).sparkSession
    before = current(spark, root, owner)
    if batch is not None and before.batch == batch:
        return before
    parts = {name: write_part(df, root, owner, name) for name, df in tables.items()}
    schemas = {name: df.schema.json() for name, df in tables.items()}
    written = {name: spark.read.schema(df.schema).parquet(parts[name][WHOLE]) for name, df in tables.items()}
    digest = "/".join(f"{name}={content_hash(df, ignore)}" for name, df in sorted(written.items()))
    last = datetime.fromisoformat(before.at) if before.at else None
    if before.digest == digest and last and now - last < timedelta(seconds=heartbeat):
        return before
    return commit(spark, root, before, parts, schemas, batch, digest, now)


def upsert(rows: DataFrame, root: str, before: Snapshot, table: str, keys: list[str], buckets: int = 64) -> dict[str, str]:
    """The table's parts with ``rows`` (one for a key) in place of the rows of their keys.

    Rows lie in buckets of their keys' hash, a folder each.  Only buckets that new rows fall into are read and written anew.
    """
    spark = rows.sparkSession
    name = lambda b: f"{b}/{buckets}"
    placed = materialize(rows.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))), f"{table}_rows")
    touched = [r[0] for r in placed.select("__bucket").distinct().collect()]  # at most ``buckets``
    held = before.parts.get(table, {})
    if any(not part.endswith(f"/{buckets}") for part in held):
        raise ValueError(f"{table} is kept in another number of buckets")
    folders = [held[name(b)] for b in touched if name(b) in held]
    if folders:
        old = spark.read.schema(schema_of(before, table)).parquet(*folders)
        old = old.join(placed.select(*keys), keys, "left_anti").withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
        placed = old.unionByName(placed, allowMissingColumns=True)
    folder = f"{root}/{before.owner}/{table}/{uuid.uuid4().hex}"
    placed.repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
    return held | {name(b): f"{folder}/__bucket={b}" for b in touched}
