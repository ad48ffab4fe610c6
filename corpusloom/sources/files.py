"""Folders through Hadoop's file systems: what is there, small files, and what is dropped."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    fs, target = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that nobody has written yet; False if there is one.

    It is written beside its place and moved there, so that no reader meets a half; moving fails where the name is taken.
    """
    fs, target = file_system(spark, path)
    _, aside = file_system(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    done = not fs.exists(target) and fs.rename(aside, target)
    if not done:
        fs.delete(aside, False)
    return done


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = file_system(spark, path)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def drop(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)
