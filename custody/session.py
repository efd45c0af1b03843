"""Session settings the library relies on, and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change results (zone, duplicate JSON keys) or plans (AQE).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


# To be given when a session is built: recording a Python stack per column call
# makes large expressions slow to build.
STATIC_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

_local_base: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings on an existing session."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's checkpoint folder.

    Only a session on one machine (``local`` or ``local[n]``) may go without one: its
    executors share the local disk, so a temporary folder serves. Anywhere else a
    missing setting is an error.
    """
    global _local_base
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _local_base is None:
            _local_base = tempfile.mkdtemp(prefix="custody-")
        base = _local_base
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """Deal costly per-row work evenly: tasks of so many rows, one a core at least.

    Meant for narrow rows that are about to grow (documents built or parsed). Splits say
    nothing about rows: a file's row groups may all lie in one of them, and a task's work
    must not grow with the input. The rows are counted first, from file footers where
    ``df`` is a table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)))
