"""Session settings the operators are written for."""

from __future__ import annotations

import datetime as dt
import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# AQE coalesces small shuffle partitions, splits skewed join partitions and
# turns a join into a broadcast once the real size of a side is known, so the
# operators carry no broadcast hints on anything that grows with the data.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # JSON objects with a repeated key keep the last value, as JSON.parse does.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str = "jobtide", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and staged tables.

    A session that names none gets a new local folder only where driver and
    executors are one process; on a cluster it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="jobtide-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def list_folders(spark: SparkSession, path: str, before: dt.datetime | None = None) -> list[str]:
    """Folders right below ``path``, if asked those last written before a time; none if there is no such path."""
    files, target = _file_system(spark, path)
    if not files.exists(target):
        return []
    limit = before.timestamp() * 1000 if before else float("inf")
    return [f.getPath().toString() for f in files.listStatus(target) if f.isDirectory() and f.getModificationTime() < limit]


def existing_path(spark: SparkSession, path: str) -> str | None:
    """The path as the scans name it, with its file system; null if nothing is there."""
    files, target = _file_system(spark, path)
    return files.getFileStatus(target).getPath().toUri().toString() if files.exists(target) else None


def glob_paths(spark: SparkSession, path: str) -> list[tuple[str, int, int, bool]]:
    """(path, time, size, whether it is a folder) of what a path or pattern names, as the scans see it."""
    files, target = _file_system(spark, path)
    return [(f.getPath().toString(), f.getModificationTime(), f.getLen(), f.isDirectory()) for f in files.globStatus(target) or []]


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder by its path, whatever file system it lies on."""
    files, target = _file_system(spark, path)
    files.delete(target, True)


#: Whether Spark deletes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What queries shuffle within goes from the disk when they end. A frame that was shuffled is used for one action."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="jobtide-code-")
    archive = shutil.make_archive(os.path.join(folder, "jobtide"), "zip", root, "jobtide")
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
