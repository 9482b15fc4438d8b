"""Session construction and the shared scratch location.

On a cluster the scratch root is whatever the cluster names in
``spark.checkpoint.dir`` (a shared, fault-tolerant folder).  Only when that is
unset *and* the master is local (tests, the bench) do we make our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def _default_driver_memory() -> str:
    """About 60% of physical memory, capped at 16 GB (local mode: the driver
    JVM hosts the executors too)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        return f"{max(1, min(16, int(total * 0.6 / 2**30)))}g"
    except (ValueError, OSError, AttributeError):
        return "4g"


def get_session(master: str | None = None, app: str = "styleframe",
                shuffle_partitions: int | None = None,
                driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every job here assumes.

    What the cluster or the caller has set stays: the values below are defaults
    for settings that nobody set.  ``shuffle_partitions`` is an explicit
    choice; without it a cluster's own value counts, and only a local master
    gets one that fits its cores."""
    driver_memory = driver_memory or _default_driver_memory()
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    given = SparkConf()
    cores = os.cpu_count() or 8
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # runtime (AQE) broadcast decision: a side is broadcast only when its
        # measured shuffle size is under this bound, otherwise sort-merge.
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
        "spark.sql.autoBroadcastJoinThreshold": "32MB",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": driver_memory,
        "spark.sql.files.maxPartitionBytes": "128MB",
    }
    if (master or given.get("spark.master", "local")).startswith("local"):
        conf["spark.sql.shuffle.partitions"] = str(max(8, cores))
    for k, v in conf.items():
        if given.get(k, None) is None:
            b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a cluster job needs a shared "
            "folder for checkpoints and intermediate tables")
    key = sc.applicationId
    if key not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[key] = tempfile.mkdtemp(prefix="styleframe-scratch-")
        sc.setCheckpointDir(_LOCAL_SCRATCH[key] + "/checkpoints")
    return _LOCAL_SCRATCH[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the scratch root."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df, name: str):
    """Written to the shared folder and read back: the planner knows how large it is before it plans a
    join (a checkpoint keeps the estimate), so a short side never has the long one shuffled."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint(df, eager: bool = True):
    """Reliable checkpoint (never localCheckpoint): survives executor loss."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=eager)
