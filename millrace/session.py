"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Settings a job needs whatever the cluster; sizes and parallelism stay with the deployment.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # State of streams on local disk with uploads of changes, not on the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``JOB_CONF``; keyword ``a__b`` sets the Spark property ``a.b``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = JOB_CONF | {key.replace("__", "."): str(value) for key, value in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply ``JOB_CONF`` to a session somebody else started."""
    for key, value in JOB_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` comes first, then a checkpoint folder set on the context. Where
    neither is named, a temporary folder serves a session whose tasks run in the driver's own
    process (``local`` masters); on any other master that folder would hold a part of the rows
    on each machine, so it is an error there.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    if not named:
        held = context._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else getattr(context, "_millrace_dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
        context._millrace_dir = named
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Used where a result feeds several later jobs: the lineage ends at files that outlive any
    executor, and the scan carries real sizes, so the planner knows what is small enough to
    broadcast.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, on any file system Spark knows; nothing where there is no folder."""
    system, where = _filesystem(spark, path)
    return [entry.getPath().getName() for entry in system.listStatus(where)] if system.exists(where) else []


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all it holds."""
    system, where = _filesystem(spark, path)
    system.delete(where, True)
