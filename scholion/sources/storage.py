"""Databases as folders of tables on any file system that Spark reads, through its Hadoop interface."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def tables(spark: SparkSession, database: str) -> list[str]:
    """Names of the tables of a database."""
    fs, p = _at(spark, database)
    names = (s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
    return sorted(n for n in names if not n.startswith((".", "_")))


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, whole."""
    fs, p = _at(spark, path)
    return fs.makeQualified(p).toString()


def move(spark: SparkSession, source: str, target: str) -> None:
    """Puts a folder in the place of another, which is removed."""
    fs, old = _at(spark, target)
    fs.delete(old, True)
    if not fs.rename(_at(spark, source)[1], old):
        raise OSError(f"'{source}' could not be moved to '{target}'")
    spark.catalog.refreshByPath(target)
