"""Shared scratch storage: cutting lineage with written tables.

A cut writes the frame once to the folder the cluster names in
``spark.checkpoint.dir`` and reads it back, so later stages restart from stored
files, never from a lost executor's memory. Parquet keeps column pruning and
gives the planner true sizes for its broadcast decisions.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A local session without one gets a temporary folder that goes away with
    the process; on a cluster the setting is required.
    """
    root = spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder every executor can reach")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="wayfold-scratch-")
        atexit.register(shutil.rmtree, _LOCAL[context.applicationId], ignore_errors=True)
    return _LOCAL[context.applicationId]


def session_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{scratch_root(spark)}/wayfold/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the application's folder."""
    return f"{session_folder(spark)}/{label}-{uuid.uuid4().hex}"


def drop(df: DataFrame) -> None:
    """Delete a frame that :func:`cut` stored and that no other frame needs any more."""
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        drop_path(df.sparkSession, folder)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete one folder of intermediate files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the application's intermediate tables when no frame needs them any more."""
    drop_path(spark, session_folder(spark))


def cut(df: DataFrame, label: str = "cut", tidy: bool = False) -> DataFrame:
    """Write ``df`` to shared storage and return a frame that reads it back.

    ``tidy`` is for tables as long as the input: their files are compressed more, and the shuffle files of the
    write are deleted when it ends, since only the stored frame is read from then on.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if not tidy:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before else spark.conf.unset(_CLEAN)
    return spark.read.schema(df.schema).parquet(path)
