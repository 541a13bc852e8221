"""Folders of the store's file system: what there is, and removing it.

These few calls go to Hadoop's file system through the session's JVM, since
DataFrames can neither delete nor tell an empty folder from an absent one. They
need a classic session, not a Connect one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _path(spark, path)
    return system.exists(target)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        target, system = _path(spark, path)
        system.delete(target, True)


def matching(spark: SparkSession, base: str, pattern: str, folders: bool = True) -> list[str]:
    """Folders (or files) below `base` that match `pattern`, relative to it."""
    home, system = _path(spark, base)
    if not system.exists(home):
        return []
    root = system.getFileStatus(home).getPath().toString().rstrip("/") + "/"
    found = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{pattern}"))
    return sorted(
        status.getPath().toString().removeprefix(root)
        for status in found or []
        if bool(status.isDirectory()) == folders
    )
