"""Spark session defaults and shared-storage helpers.

Everything that must survive an executor loss (checkpoints, materialized
intermediate tables, export output) goes below the cluster's shared
``spark.checkpoint.dir``. We only pick our own folder when the session has none
(local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session settings the operators rely on. AQE re-plans joins from runtime sizes
# (broadcast only below ``autoBroadcastJoinThreshold``, which Spark checks
# against the measured size of the side), coalesces small shuffle partitions and
# splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "agora") -> SparkSession:
    """Build (or reuse) a session with the defaults above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    # checkpoint files of unreachable intermediates are removed by the context cleaner
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    builder = builder.config("spark.driver.memory", os.environ.get("AGORA_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable defaults to an existing session."""
    for key, value in DEFAULT_CONF.items():
        if key in ("spark.ui.enabled",):
            continue
        try:
            spark.conf.set(key, value)
        except Exception:  # static conf on a running session
            pass


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialized tables.

    Reads ``spark.checkpoint.dir`` from the session; only when it is unset
    (local tests) a fresh folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="agora-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared folder (never reused, never cleared)."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``agora`` importable in the Python workers of every executor.

    Operators whose tasks run Python (pandas UDFs, mapInPandas, applyInPandas)
    call this once per application: the package is zipped on the driver and
    registered with ``addPyFile``, so Spark distributes it to each executor
    (nothing is read from a machine-local folder by the executors).
    """
    import zipfile
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="agora-pkg-"), f"agora-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)
