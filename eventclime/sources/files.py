"""Folder operations on whatever file system a path names (local, HDFS, an
object store): Hadoop's file system API, called by the driver.  Only names and
whole folders are handled here; rows are read and written by Spark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in the folder (none, if there is no such folder)."""
    fs, p = _at(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def make_folder(spark: SparkSession, folder: str) -> str:
    fs, p = _at(spark, folder)
    fs.mkdirs(p)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    fs, p = _at(spark, folder)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; the target must not exist."""
    fs, p = _at(spark, source)
    _, q = _at(spark, target)
    fs.mkdirs(q.getParent())
    if fs.exists(q) or not fs.rename(p, q):
        raise OSError(f"{source} could not be renamed to {target}")


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Put a finished folder in another's place.  A reader sees the old folder
    or the new one (or, between two renames, none), never a mixture."""
    old = f"{target}.old-{uuid.uuid4().hex}"
    had = exists(spark, target)
    if had:
        move(spark, target, old)
    move(spark, source, target)
    if had:
        remove(spark, old)


def copy(spark: SparkSession, source: str, target: str) -> str:
    """Copy a folder, byte by byte through the driver: for small ones."""
    fs, p = _at(spark, source)
    to, q = _at(spark, target)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    to.mkdirs(q.getParent())
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, q, False, conf):
        raise OSError(f"{source} could not be copied to {target}")
    return target
