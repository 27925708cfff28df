"""Session helpers.

Library code never creates its own cluster settings; it reads what the session
has. ``get_spark`` is for tests, the bench and local runs only.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_local_roots: dict[str, str] = {}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "scrubspark") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A session on one machine (``local[...]``, as in tests) may have none; only
    then is a folder of its own made and remembered. Anywhere else a missing
    setting is an error, because executors could not see a driver-local folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = sc.applicationId
    if key not in _local_roots:
        _local_roots[key] = tempfile.mkdtemp(prefix="scrubspark-ckpt-")
    return _local_roots[key]


def checkpoint_dir(spark: SparkSession) -> str:
    """Make sure the session can checkpoint; return its checkpoint folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_root(spark))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder (not created yet)."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def persist_reliably(df, spark: SparkSession | None = None, eager: bool = True):
    """Cut lineage by a reliable checkpoint in the shared checkpoint folder."""
    spark = spark or df.sparkSession
    checkpoint_dir(spark)
    return df.checkpoint(eager=eager)
