"""Folders that driver and executors share, for files and tables written and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the session's checkpoint directory, deleted when the session's JVM ends.

    Where no such directory is set one of this machine is made, in local mode only; on
    a cluster, where executors would not see it, that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _local.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="strandmill-files-")
        _local[context.applicationId] = base
    path = context._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/files-{uuid.uuid4().hex[:12]}")
    store = path.getFileSystem(context._jsc.hadoopConfiguration())
    full = store.makeQualified(path)
    store.mkdirs(full)
    store.deleteOnExit(full)
    return full.toString()


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back, so that what uses it more than once does not compute it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
