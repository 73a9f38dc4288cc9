"""Operators of a training-data pipeline, each a function from DataFrame to DataFrame."""

from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library from the folder the driver has it in.

    Needed where the caller only changed ``sys.path``; a cluster gets the package by ``--py-files``.
    """
    environment, folder = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if folder not in paths:
        environment["PYTHONPATH"] = ":".join([folder, *paths])
    return spark
