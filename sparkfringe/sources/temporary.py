"""Folders for tables that only the running program reads: in the shared folder of the session, removed in the end."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # noqa: BLE001  the session has ended, and with it the way to the folder
        pass


def folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a local master may go without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='sparkfringe-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    made = f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
    atexit.register(_remove_at_exit, spark, made)
    return made
