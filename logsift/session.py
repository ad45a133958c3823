"""Session set-up."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Set on every session. Repeated keys, in JSON too, keep their last value and times are read as UTC. Constraint propagation compares every
# computed column with every other one over many projections: planning a filter on a parsed event
# would take minutes, while nothing here depends on the filters it could add. The Java compiler leaves
# generated methods over 8000 bytes to its interpreter; Spark then does better with smaller ones (17 %
# less time for the whole pipeline).
REQUIRED = {
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to an existing session."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "logsift", cores: str | None = None, **conf: str) -> SparkSession:
    """A session for tests and the bench. On a cluster, use the cluster's own session."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**REQUIRED, **conf}.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder shared by the driver and all executors: the one the cluster names in spark.checkpoint.dir, or else one
    in the warehouse, which is shared as well."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for what one run writes."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_MANAGER = "spark.sql.streaming.checkpointFileManagerClass"


@contextmanager
def quick_checkpoints(spark: SparkSession, path: str) -> Iterator[None]:
    """Streams started in here write their logs below `path` with few calls.

    In a folder of the local file system Spark's usual way starts a process `readlink` for each file it looks at, 24 in a
    micro-batch; the way by FileSystem starts none and renames as safely there. Elsewhere nothing is changed.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        yield
        return
    before = spark.conf.get(_MANAGER, None)
    spark.conf.set(_MANAGER, "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_MANAGER)
        else:
            spark.conf.set(_MANAGER, before)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a table in the shared folder and read from there: lineage ends, and a lost executor loses nothing.

    What the statement shuffled is removed once it has ended, as nothing reads it again; Spark would keep it until the driver
    happens to collect its garbage. `discard` removes the table.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that `stored` returned, once all that was made from them is stored itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
