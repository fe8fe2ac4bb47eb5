"""Folders that micro-batches write, one for each batch, named ``<kind>=<number>``."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def complete_folders(spark: SparkSession, path: str, kinds: tuple[str, ...]) -> list[tuple[int, str, str]]:
    """(number, kind, folder) of the folders under ``path`` that were written to their end, oldest first: a folder that a batch is
    writing, or writing anew after a failure, has no ``_SUCCESS`` yet."""
    fs, root = file_system(spark, path)
    found = []
    if fs.exists(root):
        for status in fs.listStatus(root):
            folder = status.getPath()
            kind, _, number = folder.getName().partition("=")
            if kind in kinds and number.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
                found.append((int(number), kind, folder.toString()))
    return sorted(found)


def remove_folder(spark: SparkSession, folder: str) -> None:
    fs, path = file_system(spark, folder)
    fs.delete(path, True)
