"""The folder that the driver and all executors share, and this application's place in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a local session gets one of its own, and any other is refused.

    A folder of one machine is a shared one only while driver and executors are one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="skerry-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it wants it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


_MARKED: set[str] = set()


def home(spark: SparkSession) -> str:
    """This application's folder; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/skerry-{spark.sparkContext.applicationId}"
    if path not in _MARKED:
        files, at = file_system(spark, path)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _MARKED.add(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    files, at = file_system(spark, path)
    files.delete(at, True)
    _MARKED.discard(path)
