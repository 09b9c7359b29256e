"""Spark session settings the metrics rely on.

The metrics only need three things from the session: timestamps interpreted in UTC (all source columns are
``timestamp_ntz`` and ``date_trunc`` goes through the session zone), ANSI arithmetic (overflow raises instead of
wrapping) and adaptive execution (runtime broadcast choice, partition coalescing and skew-join splitting).
On a cluster the session is created by the platform; :func:`apply_settings` only adds what is missing.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",  # the payload source takes key filters
}


# Settings for a large cluster (100 TB of facts, ~1000 executors). The initial shuffle partition count is high so
# that no reduce task of the big aggregates (per sender, per (period, value) pair) has to spill much; AQE coalesces
# the small shuffles of per-period aggregates back to a few partitions. Scan splits of 256 MB keep task counts
# manageable. A partition is skewed at 5x the median and above 256 MB (AQE then splits it). App labels beyond the
# broadcast threshold make a Bloom filter of their addresses (at most 32 MB) that the scan of the transactions applies before
# the join's shuffle; Spark puts it in where the transactions scanned exceed 10 GB and the labels' files are below 4 GB.
CLUSTER = {
    "spark.sql.shuffle.partitions": "16000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16MB",
    "spark.sql.files.maxPartitionBytes": "256MB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256MB",
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "4GB",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "10000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "20000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "268435456",
}


def apply_settings(spark: SparkSession, cluster: bool = False) -> SparkSession:
    """Set the settings the metrics need; with ``cluster`` also the large-cluster sizing above."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    if cluster:
        for key, value in CLUSTER.items():
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", checkpoint_dir: str | None = None) -> SparkSession:
    """Session for tests and the local bench; never used on a cluster. ``checkpoint_dir`` is needed by streams only."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerlens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in REQUIRED.items():
        builder = builder.config(key, value)
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SCRATCH: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the driver and all executors share (``spark.checkpoint.dir``); a scratch folder only for a local session
    without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = tempfile.mkdtemp(prefix="ledgerlens-", dir=os.environ.get("TMPDIR", "/tmp"))
    return _SCRATCH[app]
