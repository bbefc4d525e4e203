"""Session helpers.

Library code never creates a session; it takes the caller's. These helpers
are for tests, the bench and ad-hoc use on one machine.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "meterwise") -> SparkSession:
    """A local session tuned like the cluster one: AQE on, UI off, UTC."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("METERWISE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Recording the Python call site of every DataFrame/function call costs
        # extra JVM round trips; off, building a report's DataFrame is ~2x faster
        # (error messages lose the Python line context).
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    builder = builder.config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="meterwise-warehouse-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    The cluster's ``spark.checkpoint.dir`` always wins (read through the
    session conf, which also works over Spark Connect). Where it is unset, a
    local master (tests) gets a scratch folder; on a cluster that would put
    files on each machine's own disk, so it is an error.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        sc = None
    if sc is not None:
        current = current or sc.getCheckpointDir() or sc.getConf().get(CHECKPOINT_CONF, None)
    if not current:
        master = sc.master if sc is not None else ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="meterwise-ckpt-")
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current
