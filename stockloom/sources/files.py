"""Folders that jobs write: which of them are complete, renaming and removal.

This goes through the storage layer of the session's JVM, which Spark Connect clients don't have.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """The file system of a path and the path itself, as the cluster's storage layer knows them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a job wrote the folder to its end: the marker is written last."""
    files, place = _at(spark, f"{path}/_SUCCESS")
    return files.exists(place)


def numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of the complete folders ``name=n``, in order."""
    files, place = _at(spark, path)
    if not files.exists(place):
        return []
    found = [status.getPath().getName() for status in files.listStatus(place)]
    numbers = [int(n.removeprefix(f"{name}=")) for n in found if n.startswith(f"{name}=") and n[len(name) + 1:].isdigit()]
    return sorted(n for n in numbers if is_complete(spark, f"{path}/{name}={n}"))


def remove(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.delete(place, True)


def mark_complete(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, f"{path}/_SUCCESS")
    files.create(place, True).close()


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.exists(place)


def changed_at(spark: SparkSession, path: str) -> float:
    """Seconds since 1970 of the last change."""
    files, place = _at(spark, path)
    return files.getFileStatus(place).getModificationTime() / 1000


def rename_new(spark: SparkSession, old: str, new: str) -> bool:
    """Rename a folder unless the new name is taken; whether that was done."""
    jvm = spark._jvm
    file_system = jvm.org.apache.hadoop.fs
    _, source = _at(spark, old)
    files, target = _at(spark, new)
    qualified = files.makeQualified(target)
    context = file_system.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(getattr(file_system, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(source), qualified, no_options)
    except Py4JJavaError as failed:
        if not files.exists(target) or not files.exists(source):
            raise
        return False
    return True
