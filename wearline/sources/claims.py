"""Exclusive creation of small files, through the file system that holds them."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _file(spark, path)
    return files.exists(target)


def claim(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create ``path`` with ``text``; False if it exists. Safe against a second writer wherever the file
    system's create without overwriting is, as on HDFS."""
    target, files = _file(spark, path)
    try:
        stream = files.create(target, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def remove(spark: SparkSession, path: str) -> None:
    target, files = _file(spark, path)
    files.delete(target, False)
