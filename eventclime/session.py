"""Session settings and the shared scratch folder.

Every job in this package works in UTC (windows are calendar days) and keeps
intermediate data under the shared folder the cluster names in
``spark.checkpoint.dir``.  The folder is only chosen here when the session has
none (local runs and tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings every query relies on.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Two watermarked inputs: the slower one decides (the stream library's rule).
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
    # Stream state off-heap in RocksDB (large join and window state spills to
    # local disk and is checkpointed to the stream's checkpoint folder).
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(
    master: str = "local[8]",
    app_name: str = "eventclime",
    shuffle_partitions: int = 8,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the package's settings."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        # call sites of column expressions cost more than making them
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # checkpoint files of DataFrames that went out of scope are removed
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in {**RUNTIME_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session someone else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for checkpoints and scratch tables.

    Read from ``spark.checkpoint.dir``; only when that is unset and the
    master is local (tests) a fresh local folder is made and registered.  On
    a cluster a folder of one machine would lose rows, so that is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote sessions have no SparkContext
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if conf_dir:
        if sc is not None and not current:
            sc.setCheckpointDir(conf_dir)
        return conf_dir.rstrip("/")
    if current:
        return current.rstrip("/")
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="eventclime-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(local)
    else:
        spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder (never reused)."""
    return f"{shared_dir(spark)}/eventclime-scratch/{name}-{uuid.uuid4().hex}"
