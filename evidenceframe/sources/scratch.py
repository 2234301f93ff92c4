"""The folder for files between jobs, which the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_folders: dict[str, str] = {}


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder all executors share: spark.checkpoint.dir. What lies there goes when the application ends.

    Where that is unset, a local session (tests) gets a temporary folder; on a cluster, whose executors wouldn't
    see it, that is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="evidenceframe-"))
        base = sc.getCheckpointDir()
    own = f"{base}/evidenceframe-{sc.applicationId}"
    if _folders.get(sc.applicationId) != own:
        path, fs = hadoop_path(spark, own)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _folders[sc.applicationId] = own
    return f"{own}/{uuid.uuid4().hex}"
