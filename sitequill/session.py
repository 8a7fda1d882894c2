"""Spark session defaults and small helpers shared by every job."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "sitequill") -> SparkSession:
    """Session for tests, the bench and local runs.

    On a cluster the submitting environment already owns master, memory and
    ``spark.checkpoint.dir``; we only fill in what is unset.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Pages are a few kB to a few MB: 512 pages per Arrow batch, and 64-bit
        # string offsets so a batch of large pages cannot overflow 2 GB.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
        .config("spark.sql.execution.arrow.useLargeVarTypes", "true")
        .config("spark.driver.memory", os.environ.get("SITEQUILL_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.master.startswith("local["):
        # Local tables are small: without this a whole table is one split, read by
        # one core. A cluster keeps its own split size (CLUSTER_SETTINGS).
        spark.conf.set("spark.sql.files.maxPartitionBytes", os.environ.get("SITEQUILL_SPLIT_BYTES", "1m"))
        spark.conf.set("spark.sql.files.openCostInBytes", "64k")
    ensure_checkpoint_dir(spark)
    return spark


# Settings meant for a large cluster run (100 TB of captured pages); the
# submitting environment applies them, the library does not force them.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
    # Initial shuffle width ~ shuffled bytes / 256 MB; AQE coalesces from there.
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "256MB",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.useLargeVarTypes": "true",
    # Set by the cluster to a shared file system; read, never overridden.
    # "spark.checkpoint.dir": "<shared folder>",
}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared file system; a
    machine-local folder is used only in local mode (tests), where driver and
    executors are one process. Anywhere else an unset folder is an error: each
    executor would write to its own disk and later reads would miss rows.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="sitequill-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever file system it is."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _dropping_shuffles(spark: SparkSession):
    """Shuffle files of an execution go when it ends: what it wrote stays."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and
    read it back: later stages start from the written files (an executor loss
    recomputes nothing upstream), the data is computed once, AQE still sizes
    the written partitions, and readers prune columns. Never a local checkpoint.
    The shuffle files behind the written table are dropped with its execution.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    with _dropping_shuffles(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)
