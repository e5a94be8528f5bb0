"""Session construction and the shared checkpoint/warehouse location.

On a cluster the operator names a shared folder in ``spark.checkpoint.dir``;
everything this library materialises (the loaded 3NF tables, lineage cuts) goes
below it.  A machine-local temporary folder is only created when the setting is
absent, which is the case in tests and local benchmarking.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(
    app_name: str = "churnlens",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings the operators assume.

    AQE is on so that shuffle partition counts coalesce to the real data volume
    and skewed join partitions are split at run time.  The UI stays off: no
    server is opened by this library.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a folder as Spark's own readers and writers see it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def checkpoint_root(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    Order: the context's checkpoint directory, then ``spark.checkpoint.dir``
    from the session configuration.  Where both are absent, a ``local`` master
    (tests, local runs) gets a temporary folder, registered as the context's
    checkpoint directory; any other master fails, since its executors would
    not see such a folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError(f"{_CHECKPOINT_KEY} is not set: it must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="churnlens-ckpt-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique folder name below the checkpoint root (never reused)."""
    root = checkpoint_root(spark)
    return os.path.join(root, f"{label}-{uuid.uuid4().hex[:12]}")
