"""Session settings shared by jobs, tests and the bench.

On a cluster the session comes from the platform; ``tune`` only sets what the jobs rely on
(UTC session zone, ANSI mode, adaptive execution with skew handling). ``checkpoint_dir``
reads ``spark.checkpoint.dir`` from the session and only falls back to a scratch folder
when nothing is configured (local tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job assumes. Adaptive execution re-plans joins from measured shuffle sizes
# (runtime broadcast only below the threshold, sort-merge beyond it), splits skewed
# partitions and coalesces small ones.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.files.maxPartitionBytes": "128m",
}

# A plan is first made from the sizes of compressed files, and 1 MB of Parquet can be 40 MB of rows in a
# broadcast, all built on the driver. Beyond the first size, of files, a join waits for the measured size of its rows;
# the second is lower than above because the whole replacement job has a dozen such joins at the same time.
BOUNDED_BROADCASTS = {
    "spark.sql.autoBroadcastJoinThreshold": "1m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "8m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the jobs depend on to an existing session."""
    for k, v in JOB_CONF.items():
        spark.conf.set(k, v)
    return spark


def bound_broadcasts(spark: SparkSession) -> SparkSession:
    """Broadcast by the size of files only where it is tiny, else by measured rows; holds until ``tune`` is called again."""
    for k, v in BOUNDED_BROADCASTS.items():
        spark.conf.set(k, v)
    return spark


def get_session(master: str | None = None, cpus: int | None = None,
                shuffle_partitions: int | None = None, app: str = "opsmetrics") -> SparkSession:
    """Local session for tests and the bench. Cluster jobs pass their own session."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in JOB_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only when the session has none and runs in local mode (tests) is a scratch folder
    created and set; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if not current:
            sc.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not sc.master.startswith("local"):
        # a folder on the driver is not reachable from executors: require a shared one
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    local = tempfile.mkdtemp(prefix="opsmetrics-ckpt-")
    sc.setCheckpointDir(local)
    return local
