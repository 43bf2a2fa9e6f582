"""Session helpers.

Lineage cuts go to the shared folder named by ``spark.checkpoint.dir``. Only
a local session that names none gets a scratch folder of its own, made once.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app_name: str = "leadspark",
                  conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings that the plans rely on (adaptive execution,
    UTC). Sizes (memory, shuffle partitions) are the caller's or the cluster's."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Speculative copies of tasks that call external services would
        # repeat those calls; the provider stage de-duplicates anyway.
        .config("spark.speculation", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings the operators rely on (UTC for date formatting)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names, set on the context
    as well. A ``local[...]`` session that names none gets a scratch folder,
    made once; any other one is an error, as executors would not share it."""
    context = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if not path:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError(
                f"{CHECKPOINT_CONF} is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) visible to every executor")
        path = tempfile.mkdtemp(prefix="leadspark-ckpt-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def ensure_checkpoint_dir(spark: SparkSession, default: str) -> str:
    """Tests/local tools only: use ``default`` when the session names none."""
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = default
        spark.conf.set(CHECKPOINT_CONF, path)
    spark.sparkContext.setCheckpointDir(path)
    return path
