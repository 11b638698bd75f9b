"""Session settings and the shared scratch location."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are tuned for.  AQE re-plans joins from measured sizes
# and splits skewed join partitions; VARIANT duplicate keys follow "last wins".
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that adds a shuffle after it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}
# Fixed at start-up.  Call-site capture costs more than planning wide plans.
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "turnwise") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for name, value in {**SETTINGS, **STATIC_SETTINGS}.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> None:
    """Apply the runtime settings to a session made elsewhere."""
    for name, value in SETTINGS.items():
        if spark.conf.isModifiable(name):
            spark.conf.set(name, value)


def share_package(spark: SparkSession) -> None:
    """Put this package on the path of the Python workers, for operators that run in them."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    given = spark.sparkContext.environment
    if root not in given.get("PYTHONPATH", "").split(os.pathsep):
        given["PYTHONPATH"] = os.pathsep.join(x for x in (root, given.get("PYTHONPATH", "")) if x)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; where that is unset, the
    warehouse, which all executors share too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/turnwise_scratch"


def write_scratch(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet in the shared folder; give the path."""
    target = f"{scratch_root(df.sparkSession)}/turnwise/{name}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return target


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where several branches would otherwise parse the same text again.  The
    copy is columnar (later reads still prune columns and push filters), cuts
    the lineage, and does not depend on any executor staying alive.
    """
    target = write_scratch(df, name)
    out = df.sparkSession.read.schema(df.schema).parquet(target)
    out.scratch_folder = target
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more, neither now nor lazily."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for row work that costs far more than moving the row.

    A small file gives one task however many cores wait, and a large one can
    give many tasks of which most are empty: a Parquet file is cut between its
    row groups only, and one of them can hold a million rows.  So rows are
    always dealt out, those of large tables to four tasks per core.
    """
    cores, given = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores if given < cores else max(given, 4 * cores))
