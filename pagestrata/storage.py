"""The folder that the driver and all executors share (``spark.checkpoint.dir``), and files in it or in any other store."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of this machine only where none is named and Spark runs in this process."""
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"{SETTING} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="pagestrata-")
    return _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it is removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/pagestrata/{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def filesystem(uri: str):
    """(file system, path in it) of a URI or a local path, for use in Python workers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri.removeprefix('file:'))}")
