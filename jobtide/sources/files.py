"""File-system calls on the folders of tables, through the file system that the path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder has, in order; nothing where there is no folder."""
    system, where = _at(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []


def delete(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.delete(where, True)


def make(spark: SparkSession, path: str) -> bool:
    """Make an empty file; false where there is one, so that of several writers one wins."""
    system, where = _at(spark, path)
    system.mkdirs(where.getParent())
    return system.createNewFile(where)
