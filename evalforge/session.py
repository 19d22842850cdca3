"""Spark session defaults and the shared lineage-cut folder.

On a cluster the session is built by the platform; ``build_session`` is for
local runs and tests.  Nothing here hard-codes a machine-local path for a
cluster: ``shared_dir`` reads ``spark.checkpoint.dir`` from the session and
only invents one (under the system temp folder) when running in local mode
with the setting unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Tables are parquet; let splits stay at the default 128 MB so a 100 TB
    # scan becomes ~800k tasks spread over the cluster.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "evalforge") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    b = SparkSession.builder.master(master).appName(app)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    b = b.config("spark.driver.memory", os.environ.get("EVALFORGE_DRIVER_MEM", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


_LOCAL_KEY = "spark.evalforge.localSharedDir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``.  If it is unset and the master is
    local, a fresh folder is created and registered with the context (tests,
    laptops; ``spark.checkpoint.dir`` itself cannot change after start-up).
    On a cluster with no setting we refuse rather than write to a node-local
    disk.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_LOCAL_KEY, None)
    if not d:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared (distributed) folder")
        d = tempfile.mkdtemp(prefix="evalforge-ckpt-")
        spark.conf.set(_LOCAL_KEY, d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared folder."""
    base = shared_dir(spark).rstrip("/")
    _SCRATCH.append(f"{base}/{name}-{uuid.uuid4().hex[:12]}")
    return _SCRATCH[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders made so far, once the results that read them have been used."""
    jvm, n = spark.sparkContext._jvm, 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint to the shared folder (survives executor loss)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: pins what sampling or row numbers decided, cuts the
    lineage in one job, and lets the write's shuffle files go, as nothing reads them again."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_RELEASE, "false")
    spark.conf.set(_RELEASE, "true")
    try:
        w = df.write.option("compression", "zstd")
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    finally:
        spark.conf.set(_RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)
