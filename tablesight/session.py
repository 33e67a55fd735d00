"""Spark session helpers.

The library never hard-codes cluster settings: it reads what the session was
started with and only fills in defaults that are unset (local tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def _driver_memory() -> str:
    """About 60% of the machine's memory (at most 16g): local mode runs everything in
    the driver JVM, and a heap larger than the container would be killed."""
    try:
        with open("/proc/meminfo") as f:
            kb = next(int(line.split()[1]) for line in f if line.startswith("MemTotal"))
        gb = max(1, min(16, int(kb / 1024 / 1024 * 0.6)))
    except (OSError, StopIteration, ValueError):
        gb = 4
    return f"{gb}g"


def get_spark(app: str = "tablesight", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests/benchmarks."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.appName(app)
        .master(master or f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", _driver_memory())
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``.

    On a cluster the setting has to name a folder that driver and executors share
    (HDFS/S3/...); without it this is an error. Only local-mode sessions, where both
    are one process, get a scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by driver and executors")
        configured = tempfile.mkdtemp(prefix="tablesight-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
