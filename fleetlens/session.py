"""SparkSession helpers.

On a cluster the session is created by the launcher; ``get_session`` only
fills in settings that are unset, so cluster settings always win.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on; applied only where the session leaves them unset.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Size-checked broadcast: the planner broadcasts a join side only when its
    # estimated (or, under AQE, measured) size is below this bound and falls
    # back to a shuffle join beyond it.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # partitions sized for executor memory at fleet scale; AQE merges small ones
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
}


def get_session(master: str | None = None, app: str = "fleetlens",
                shuffle_partitions: int | None = None) -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    b = SparkSession.builder.appName(app)
    b = b.master(master or os.environ.get("FLEETLENS_MASTER", "local[*]"))
    b = b.config("spark.ui.enabled", "false")
    b = b.config("spark.driver.memory", os.environ.get("FLEETLENS_DRIVER_MEMORY", "16g"))
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Set the library defaults on an existing session where they are unset."""
    for k, v in DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is read, never overridden.  When it is
    unset, a local master (tests) gets a fresh scratch folder; any other raises, since its
    executors don't see the driver's folders.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:                      # no SparkContext under Spark Connect
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001
        pass
    if not d and sc is not None:
        d = sc.getCheckpointDir()
    if not d:
        if sc is None or not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="fleetlens-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # static in some deployments; the context setting below suffices
            pass
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d
